"""DuckDB counterpart of each registered query."""

from __future__ import annotations

import numpy as np

from oracle_base import FACTOR, PEAK, SEASON, define, with_ctes

RIDGE = 1.0

ORACLES: dict[str, str] = {}


def oracle(name: str, query: str, *ctes: str) -> None:
    """Register a counterpart; date columns come out as text, as in the Spark queries."""
    ORACLES[name] = with_ctes(f"{query}\n", *ctes)


def as_text(name: str, *columns: str) -> None:
    replaced = ", ".join(f"cast({c} as varchar) as {c}" for c in columns)
    ORACLES[name] = f"select * replace ({replaced}) from (\n{ORACLES[name]}\n)"


# --- derived frames --------------------------------------------------------------------------

define("base", ["sales"], f"""
  select * exclude (season, is_festival_month), {SEASON.format(d='cast(date as date)')} as season,
    cast(date as date) as dt, cast(month(dt) as integer) as month, cast(isodow(dt) - 1 as integer) as day_of_week,
    cast(day(dt) as integer) as day_of_month, cast(quarter(dt) as integer) as quarter,
    case when isodow(dt) >= 6 then 1 else 0 end as is_weekend,
    sin(2 * pi() * weekofyear(dt) / 52.0e0) as week_sin, cos(2 * pi() * weekofyear(dt) / 52.0e0) as week_cos,
    case when month(dt) in (1,3,8,9,10,11) then 1 else 0 end as is_festival_month
  from sales""")
ROLLING = """
    avg(quantity_sold) over (w rows between {a} preceding and {e}) as rolling_mean_7,
    avg(quantity_sold) over (w rows between {b} preceding and {e}) as rolling_mean_30,
    coalesce(stddev_samp(quantity_sold) over (w rows between {a} preceding and {e}), 0) as rolling_std_7"""
define("rolled", ["base"], f"""
  select *, case season when 'Summer' then 0 when 'Monsoon' then 1 when 'Post-Monsoon' then 2 when 'Winter' then 3 else 0 end as season_encoded,
    {PEAK.format(s='season', c='category')} as is_peak_disease_season,
    lag(quantity_sold, 1) over (w) as lag_1, lag(quantity_sold, 7) over (w) as lag_7, lag(quantity_sold, 30) over (w) as lag_30,
    {ROLLING.format(a=6, b=29, e='current row')},
    row_number() over (w) - 30 as frame_no, count(*) over (partition by product_id) - 30 as frame_rows
  from base window w as (partition by product_id order by dt)""")
define("features", ["rolled"], "select * from rolled where lag_30 is not null")

# The order of the features.
FEATURES = (
    "quantity_sold", "month", "day_of_week", "day_of_month", "quarter", "is_weekend", "week_sin", "week_cos", "season_encoded",
    "is_festival_month", "is_peak_disease_season", "lag_1", "lag_7", "lag_30", "rolling_mean_7", "rolling_mean_30", "rolling_std_7",
)
define("bounds", ["features"], "select product_id, " + ", ".join(
    f"cast(min({c}) as double) as lo_{c}, cast(max({c}) as double) as hi_{c}" for c in FEATURES
) + " from features group by product_id")
define("scaled", ["features", "bounds"], "select f.product_id, f.dt, f.frame_no, f.frame_rows, lo_quantity_sold as lo, hi_quantity_sold as hi, " + ", ".join(
    f"(cast({c} as double) - lo_{c}) / (case when hi_{c} = lo_{c} then 1e0 else hi_{c} - lo_{c} end) as {c}" for c in FEATURES
) + " from features f join bounds b on f.product_id = b.product_id")
define("vectors", ["scaled"], "select *, [" + ", ".join(FEATURES) + "] as v from scaled")
define("windows", ["vectors"], """
  select *, list(v) over (partition by product_id order by dt rows between 30 preceding and 1 preceding) as x
  from vectors qualify frame_no > 30""")
define("seqs", ["windows"], """
  select product_id, dt as date, x, quantity_sold as y, frame_no - 30 as seq_no, frame_rows - 30 as seq_rows from windows""")

define("trend_sums", ["features"], """
  select product_id, max(dt) as last_date, cast(count(*) as bigint) as n, cast(sum(x) as bigint) as sx, cast(sum(y) as bigint) as sy,
    cast(sum(x * y) as bigint) as sxy, cast(sum(x * x) as bigint) as sxx, cast(sum(y * y) as bigint) as syy
  from (select product_id, dt, frame_no - greatest(frame_rows - 30, 0) - 1 as x, cast(quantity_sold as bigint) as y
        from features where frame_no > frame_rows - 30) group by product_id""")
define("trend", ["trend_sums"], """
  select product_id, last_date, cast(sy as double) / cast(n as double) as mean,
    case when n < 2 then 0e0 else cast(n * sxy - sx * sy as double) / cast(n * sxx - sx * sx as double) end as slope,
    sqrt(cast(n * syy - sy * sy as double)) / cast(n as double) as deviation
  from trend_sums""")
define("days", ["trend"], """
  select product_id, day_no, cast(last_date + day_no as date) as date,
    greatest(1, cast(trunc(mean + slope * (day_no - 1)) as bigint)) as quantity
  from trend, (select cast(range as integer) as day_no from range(1, 61))""")
NOISE = ", ".join(f"{z!r}" for z in np.random.RandomState(42).standard_normal(60).tolist())
define("noisy", ["trend"], f"""
  select product_id, day_no, cast(last_date + day_no as date) as date,
    greatest(1, cast(trunc(mean + slope * (day_no - 1) + deviation * 0.3e0 * (cast([{NOISE}] as double[]))[day_no]) as bigint)) as quantity
  from trend, (select cast(range as integer) as day_no from range(1, 61))""")
define("predicted30", ["days"], """
  select product_id, cast(sum(quantity) as bigint) as predicted from days where day_no <= 30 group by product_id""")
define("now_season", ["sales"], f"select {SEASON.format(d='max(cast(date as date))')} as season from sales")
define("demand30", ["predicted30", "trend", "now_season"], """
  select p.product_id, p.predicted, t.mean, s.season from predicted30 p join trend t using (product_id), now_season s""")
define("demand_seasons", ["predicted30", "trend"], """
  select p.product_id, p.predicted, t.mean, s.season from predicted30 p join trend t using (product_id),
    (values ('Summer'), ('Monsoon'), ('Post-Monsoon'), ('Winter')) s(season)""")
define("demand_spans", ["noisy", "trend", "now_season"], """
  select n.product_id, h.horizon, cast(sum(quantity) as bigint) as predicted, avg(quantity) as mean_quantity, any_value(t.mean) as mean, any_value(s.season) as season
  from noisy n join (values (7), (30), (60)) h(horizon) on n.day_no <= h.horizon join trend t using (product_id), now_season s
  group by n.product_id, h.horizon""")


def define_recommendation(suffix: str, source: str) -> None:
    """rec<suffix>: the recommendation record of each row of ``source``."""
    define(f"rec{suffix}_a", [source, "catalog"], f"""
      select d.*, c.product_name, c.category, c.unit_price, c.lead_time_days, {FACTOR.format(s='d.season', c='c.category')} as factor
      from {source} d join catalog c using (product_id)""")
    define(f"rec{suffix}_b", [f"rec{suffix}_a"], f"""
      select *, greatest(1, cast(trunc(mean * lead_time_days * 0.5e0) as bigint)) as safety_stock,
        (case season when 'Summer' then 0.18e0 when 'Monsoon' then 0.25e0 when 'Post-Monsoon' then 0.15e0 when 'Winter' then 0.20e0 else 0.15e0 end)
          + (case when factor > 1.3e0 then 0.05e0 else 0e0 end) as buffer
      from rec{suffix}_a""")
    define(f"rec{suffix}", [f"rec{suffix}_b"], f"""
      select *, cast(trunc(mean * lead_time_days) as bigint) + safety_stock as reorder_point,
        greatest(safety_stock, cast(trunc(predicted * buffer) as bigint)) as buffer_units,
        predicted + greatest(safety_stock, cast(trunc(predicted * buffer) as bigint)) as recommended_stock,
        round_even(buffer * 100, 1) as buffer_pct, round_even(mean, 1) as avg_daily_demand, round_even(factor, 2) as seasonal_factor
      from rec{suffix}_b""")


for span in (7, 60):
    define(f"predicted{span}", ["days"], f"""
      select product_id, cast(sum(quantity) as bigint) as predicted from days where day_no <= {span} group by product_id""")
    define(f"demand{span}", [f"predicted{span}", "trend", "now_season"], f"""
      select p.product_id, p.predicted, t.mean, s.season from predicted{span} p join trend t using (product_id), now_season s""")
    define_recommendation(str(span), f"demand{span}")
define_recommendation("", "demand30")
define_recommendation("_seasons", "demand_seasons")
define_recommendation("_spans", "demand_spans")
define("demand_cases", ["predicted7", "trend"], """
  select p.product_id, p.predicted, t.mean / slower as mean, s.season from predicted7 p join trend t using (product_id)
    cross join (values ('Summer'), ('Monsoon'), ('Post-Monsoon'), ('Winter')) s(season) cross join (values (1e0), (4e0), (16e0)) f(slower)""")
define_recommendation("_cases", "demand_cases")

define("counts", ["catalog"], """
  select product_id, category, cast(trunc(value * base_demand) as integer) as new_quantity, ts
  from events join catalog on product_id = 'P' || lpad(cast(1 + user_id % 25 as varchar), 3, '0') where event_type = 'purchase'""")
define("newest", ["counts"], """
  select product_id, greatest(0, arg_max(new_quantity, (ts, new_quantity))) as quantity, max(ts) as ts from counts group by product_id""")
define("inventory", ["catalog", "newest"], """
  select coalesce(c.product_id, n.product_id) as product_id,
    cast(case when n.ts is not null then n.quantity else c.base_demand * 30 end as integer) as current_stock, n.ts as last_updated
  from catalog c full join newest n on c.product_id = n.product_id""")


def define_alerts(suffix: str) -> None:
    """alerts<suffix>: every row of rec<suffix> with its stock and alert columns."""
    if suffix == "_cases":
        define("stocked_cases", ["rec_cases"], """
          select *, recommended_stock * percent // 100 as current_stock
          from rec_cases cross join (values (0), (49), (50), (79), (80), (89), (100), (130), (131)) p(percent)""")
    else:
        define(f"stocked{suffix}", [f"rec{suffix}", "inventory"], f"""
          select r.*, cast(coalesce(i.current_stock, 0) as bigint) as current_stock
          from rec{suffix} r left join inventory i on r.product_id = i.product_id""")
    define(f"typed{suffix}", [f"stocked{suffix}"], f"""
      select *, current_stock::double / recommended_stock::double as share,
        case when recommended_stock = 0 then null
          when current_stock::double / recommended_stock::double < 0.5e0 then 'CRITICAL'
          when seasonal_factor > 1.5e0 and current_stock::double / recommended_stock::double < 0.9e0 then 'SEASONAL_RISK'
          when current_stock <= reorder_point then 'RESTOCK_SOON'
          when current_stock::double / recommended_stock::double < 0.8e0 then 'LOW_STOCK'
          when current_stock::double / recommended_stock::double > 1.3e0 then 'OVERSTOCK' end as alert_type
      from stocked{suffix}""")
    define(f"alerted{suffix}", [f"typed{suffix}"], f"""
      select *, recommended_stock - current_stock as gap,
        cast(cast(round_even(share * 100, 0) as bigint) as varchar) || '%' as pct,
        case alert_type when 'CRITICAL' then 'critical' when 'OVERSTOCK' then 'info' else case when alert_type is not null then 'warning' end end as severity,
        case alert_type when 'CRITICAL' then '🔴 Critical' when 'SEASONAL_RISK' then '🌡️ Seasonal Risk' when 'RESTOCK_SOON' then '🟠 Restock Soon'
          when 'LOW_STOCK' then '🟡 Low Stock' when 'OVERSTOCK' then '📦 Overstock' end as label,
        split_part(label, ' ', 1) as icon,
        case when alert_type <> 'OVERSTOCK' then gap end as deficit, case when alert_type = 'OVERSTOCK' then -gap end as excess,
        case alert_type
          when 'CRITICAL' then 'Stock critically low — only ' || pct || ' of recommended. Order ' || format('{{:,}}', gap) || ' units urgently.'
          when 'SEASONAL_RISK' then 'High-season item at ' || pct || ' stock (demand ×' || cast(seasonal_factor as varchar) || '). Consider early restocking.'
          when 'RESTOCK_SOON' then 'Stock below reorder point (' || format('{{:,}}', reorder_point) || '). Place order for ' || format('{{:,}}', gap) || ' units.'
          when 'LOW_STOCK' then 'Stock at ' || pct || ' of recommended. Monitor closely.'
          when 'OVERSTOCK' then 'Overstocked by ' || format('{{:,}}', -gap) || ' units. Risk of expiry — delay next order.' end as message
      from typed{suffix}""")


for suffix in ("", "_seasons", "_cases", "7", "60"):
    define_alerts(suffix)
TITLE = "upper(category[1]) || category[2:]"

# --- sources and sinks -----------------------------------------------------------------------

oracle("scan_sales", "select * replace (cast(date as date) as date) from sales", "sales")
oracle("append_sales", """
  select product_id, substr(cast(date as varchar), 1, 4) as year, count(*) as rows, max(cast(date as varchar)) as last_date,
    cast(sum(quantity_sold + case when substr(cast(date as varchar), 1, 4) >= '1997' and isodow(cast(date as date)) = 1 then 1 else 0 end) as bigint) as units
  from sales group by all""", "sales")
oracle("load_sales_table", "select count(*) as rows, cast(sum(quantity_sold) as bigint) as units from sales", "sales")
oracle("derived_sales", "select * from sales", "sales")
oracle("derived_catalog", "select * from catalog", "catalog")
oracle("sales_profile", """
  select 'ok' as status, count(*) as rows, min(date) as date_from, max(date) as date_to, count(distinct product_id) as products from sales""", "sales")
oracle("custom_sql", """
  select category, season, count(distinct product_id) as products, cast(sum(quantity_sold) as bigint) as units from sales
  where quantity_sold > 0 group by 1, 2""", "sales")
oracle("parameter_sql", """
  select product_name, count(*) as days, cast(sum(quantity_sold) as bigint) as total_sold from sales
  where category = 'fever' and quantity_sold >= 50 group by 1""", "sales")

# --- projections -----------------------------------------------------------------------------

oracle("calendar_features", "select product_id, dt as date, month, day_of_week, day_of_month, quarter, is_weekend from base", "base")
oracle("week_cyclical", "select product_id, dt as date, round(week_sin, 9) + 0e0 as week_sin, round(week_cos, 9) + 0e0 as week_cos from base", "base")
oracle("season_features", "select product_id, dt as date, season, season_encoded, is_festival_month from rolled", "rolled")
oracle("peak_season_flag", "select product_id, dt as date, season, category, is_peak_disease_season from features", "features")
oracle("product_sales", """
  select date, quantity_sold, revenue, current_stock, season, is_festival_month from sales where product_id = 'P007' order by date""", "sales")
oracle("lag_features", "select product_id, dt as date, quantity_sold, lag_1, lag_7, lag_30 from features", "features")
ROUNDED_ROLLING = "round(rolling_mean_7, 6) as rolling_mean_7, round(rolling_mean_30, 6) as rolling_mean_30, round(rolling_std_7, 6) as rolling_std_7"
oracle("rolling_stats", f"select product_id, dt as date, {ROUNDED_ROLLING} from features", "features")
oracle("rolling_stats_shifted", f"""
  select product_id, dt as date, {ROUNDED_ROLLING} from (
    select product_id, dt, lag(quantity_sold, 30) over w as lag_30, {ROLLING.format(a=7, b=30, e='1 preceding')}
    from base window w as (partition by product_id order by dt)) where lag_30 is not null""", "base")
oracle("feature_vector", "select product_id, dt as date, 17 as n_features, round(" + " + ".join(
    f"{c} * {i}.0e0" for i, c in enumerate(FEATURES, 1)) + ", 4) as checksum from features", "features")
oracle("tabular_features", "select product_id, dt as date, 16 as n_features, round(" + " + ".join(
    f"{c} * {i}.0e0" for i, c in enumerate(FEATURES[1:], 1)) + ", 4) as checksum, cast(quantity_sold as double) as y from features", "features")
oracle("revenue_derived", "select product_id, date, round(quantity_sold * unit_price, 2) as revenue from sales", "sales")
oracle("expiry_risk_flag", f"""
  select s.product_id, s.date, case when s.current_stock > c.base_demand * {FACTOR.format(s='s.season', c='s.category')} * 60 then 1 else 0 end as expiry_risk
  from sales s join catalog c using (product_id)""", "sales", "catalog")

# --- aggregates ------------------------------------------------------------------------------

SUM = "cast(sum(quantity_sold) as bigint)"
AVG1 = "round(avg(quantity_sold), 1)"
REV = "round(sum(revenue), 2)"
oracle("preset_top10_products", f"""
  select product_name, {SUM} as total_sold, {AVG1} as avg_daily from sales group by 1 order by total_sold desc, product_name limit 10""", "sales")
oracle("preset_monthly_trend", f"select substr(date, 1, 7) as month, {SUM} as total_sales, {REV} as total_revenue from sales group by 1", "sales")
oracle("preset_seasonal_category", f"select season, category, {SUM} as total_demand, {AVG1} as avg_daily from sales group by 1, 2", "sales")
for name, direction in (("preset_slow_bottom5", "asc"), ("preset_fast_top5", "desc")):
    oracle(name, f"""select product_name, category, {AVG1} as avg_daily_demand, {SUM} as total_sold from sales group by 1, 2
      order by avg_daily_demand {direction}, product_name limit 5""", "sales")
oracle("preset_season_revenue", f"select season, {REV} as total_revenue, round(avg(revenue), 2) as avg_daily_revenue, {SUM} as total_units from sales group by 1", "sales")
oracle("expiry_risk_products", """
  select product_name, category, cast(sum(expiry_risk) as bigint) as expiry_risk_days, round(avg(current_stock), 0) as avg_stock
  from sales where expiry_risk = 1 group by 1, 2""", "sales")
oracle("preset_festival_vs_normal", f"select product_name, is_festival_month, {AVG1} as avg_daily_demand from sales group by 1, 2", "sales")
oracle("preset_yoy", f"select substr(date, 1, 4) as year, {SUM} as total_units, {REV} as total_revenue from sales group by 1", "sales")
oracle("low_stock_days", """
  select product_name, count(*) as low_stock_days from sales
  where current_stock < (select avg(quantity_sold) * 7 from sales s2 where s2.product_id = sales.product_id) group by 1""", "sales")
oracle("top_selling", f"""
  select product_name, category, {SUM} as total_sold, {AVG1} as avg_daily, {REV} as total_revenue from sales
  group by 1, 2 order by total_sold desc, product_name limit 10""", "sales")
oracle("monthly_trend", f"""
  select substr(date, 1, 7) as month, {SUM} as total_units, {REV} as total_revenue, count(distinct product_id) as products_sold from sales group by 1""", "sales")
oracle("monthly_trend_tail", f"""
  select substr(date, 1, 7) as month, {SUM} as total_units, {REV} as total_revenue, count(distinct product_id) as products_sold
  from sales group by 1 order by 1 desc limit 6""", "sales")
oracle("seasonal_demand", f"select season, product_name, category, {SUM} as total_demand, {AVG1} as avg_daily from sales group by 1, 2, 3", "sales")
oracle("slow_movers", f"""
  select product_name, category, {AVG1} as avg_daily_demand, {SUM} as total_sold from sales group by 1, 2 having {AVG1} < (select avg(quantity_sold) from sales)""", "sales")
oracle("category_revenue", f"select category, {REV} as total_revenue, {SUM} as total_units, {AVG1} as avg_daily from sales group by 1", "sales")
oracle("eda_monthly", f"select substr(date, 1, 7) as month, {SUM} as total_units, {REV} as total_revenue from sales group by 1", "sales")
oracle("eda_top_products", f"select product_name, {SUM} as total_units from sales group by 1 order by total_units desc, product_name limit 12", "sales")
oracle("eda_category_share", """
  select category, round(sum(revenue), 2) as revenue, round(sum(revenue) * 100 / (sum(sum(revenue)) over ()), 6) as share_pct from sales group by 1""", "sales")
oracle("eda_season_category", "select season, category, round(avg(quantity_sold), 6) as avg_daily_demand from sales group by 1, 2", "sales")
oracle("eda_movers", "select product_name, category, round(avg(quantity_sold), 6) as avg_daily_demand from sales group by 1, 2", "sales")
oracle("eda_histogram", """
  select cast(bin as integer) as bin, round(lo + bin * width, 6) as bin_start, count(*) as days from (
    select lo, width, least(floor((quantity_sold - lo) / width), 59) as bin from sales,
      (select cast(min(quantity_sold) as double) as lo, (max(quantity_sold) - min(quantity_sold)) / 60.0e0 as width from sales))
  group by bin, lo, width""", "sales")
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
oracle("eda_heatmap", "select product_id, cast(year(dt) as integer) as year, " + ", ".join(
    f"cast(coalesce(round_even(avg(quantity_sold) filter (where month = {i}), 0), 0) as integer) as {m}" for i, m in enumerate(MONTHS, 1)
) + " from features group by 1, 2", "features")
oracle("eda_day_of_week", """
  select product_id, day_of_week, (['Mon','Tue','Wed','Thu','Fri','Sat','Sun'])[day_of_week + 1] as day, round(avg(quantity_sold), 6) as avg_quantity
  from features group by 1, 2""", "features")
oracle("eda_yoy_product", f"select cast(year(cast(date as date)) as integer) as year, product_name, {SUM} as total_units from sales group by 1, 2", "sales")
oracle("demand_stats", """
  select product_name, round_even(avg(quantity_sold), 1) as mean, round_even(stddev_samp(quantity_sold), 1) as std,
    min(quantity_sold) as min, max(quantity_sold) as max from sales group by 1""", "sales")
oracle("product_summary", f"""
  select f.product_id, {SUM} as total_sold, round_even(avg(quantity_sold), 1) as avg_daily, max(quantity_sold) as max_daily,
    min(quantity_sold) as min_daily, round_even(stddev_samp(quantity_sold), 1) as std_daily, any_value(c.unit_price) as unit_price,
    any_value(c.lead_time_days) as lead_time_days, any_value(upper(c.category[1]) || c.category[2:]) as category
  from features f join catalog c using (product_id) group by 1""", "features", "catalog")
oracle("catalog_movers", """
  select product_id, product_name, case when base_demand >= 90 then 'fast' else 'slow' end as mover
  from catalog where base_demand >= 90 or base_demand <= 45""", "catalog")

# --- windows, scaling, sequences -------------------------------------------------------------

oracle("eda_moving_average", """
  select product_id, dt as date, quantity_sold,
    case when frame_no >= 7 then round(avg(quantity_sold) over (w rows 6 preceding), 6) end as ma_7,
    case when frame_no >= 30 then round(avg(quantity_sold) over (w rows 29 preceding), 6) end as ma_30
  from features window w as (partition by product_id order by dt)""", "features")
ORACLES["order_line_lags"] = """
  with numbered as (
    select p_brand as product_id, year(l_shipdate) as year, l_quantity as quantity, row_number() over w as row_no, lag(l_quantity, 1) over w as lag_1,
      lag(l_quantity, 30) over w as lag_30, avg(l_quantity) over (w rows 6 preceding) as mean_7
    from lineitem join part on l_partkey = p_partkey
    window w as (partition by p_brand order by cast(l_shipdate as date), l_orderkey, l_linenumber, l_quantity))
  select product_id, year, count(*) as rows, max(row_no) - 30 as last_no, cast(sum(lag_1) as bigint) as lag_1, cast(sum(lag_30) as bigint) as lag_30,
    cast(sum(round(mean_7 * 420)) as bigint) as mean_7
  from numbered where row_no > 30 group by all"""
oracle("last_n_history", """
  select product_id, dt as date, quantity_sold from features
  qualify row_number() over (partition by product_id order by dt desc) <= 90""", "features")
oracle("chrono_split", """
  select product_id, count(*) filter (where t) as train_rows, count(*) filter (where not t) as test_rows, max(dt) filter (where t) as last_train_date
  from (select *, row_number() over (partition by product_id order by dt) <= trunc(count(*) over (partition by product_id) * 0.8e0) as t from features)
  group by 1""", "features")
oracle("scaler_params", " union all ".join(
    f"select product_id, '{c}' as feature, round(lo_{c}, 6) as min, round(hi_{c}, 6) as max from bounds" for c in FEATURES), "bounds")
oracle("minmax_scaled", "select product_id, dt as date, " + ", ".join(f"round({c}, 6) as {c}" for c in FEATURES) + " from scaled", "scaled")
oracle("inverse_scaled", "select product_id, dt as date, round(cast(quantity_sold as double), 6) as quantity from features", "features")
oracle("sequence_windows", """
  select product_id, date, cast(len(x) as integer) as n_rows, cast(len(flatten(x)) as integer) as n_values, round(x[1][1], 6) as first_value,
    round(x[30][1], 6) as last_target, round(list_sum(flatten(x)), 4) as checksum, round(y, 6) as y from seqs""", "seqs")
oracle("training_sets", """
  select product_id, seq_no <= floor(seq_rows * 0.8e0) as is_train, count(*) as n, min(date) as date_from, max(date) as date_to,
    cast(sum(len(x)) as bigint) as window_rows, round(sum(y), 4) as y_total from seqs group by 1, 2""", "seqs")
define("ledger_steps", ["sales", "catalog"], f"""
  select s.product_id, cast(s.date as date) as dt, s.quantity_sold as q, c.base_demand as base, s.lead_time_days as lead,
    {FACTOR.format(s='s.season', c='s.category')} as mult, row_number() over (partition by s.product_id order by s.date) as n
  from sales s join catalog c using (product_id)""")
define("ledger_days", ["ledger_steps"], """
  select product_id, n, dt, cast(greatest(0, base * 45 + cast(floor(base * mult * lead * 1.2e0) as bigint) - q) as bigint) as stock
  from ledger_steps where n = 1
  union all
  select s.product_id, s.n, s.dt, cast(greatest(0, r.stock - s.q
    + case when (s.n - 1) % s.lead = 0 then cast(floor(s.base * s.mult * s.lead * 1.2e0) as bigint) else 0 end) as bigint)
  from ledger_days r join ledger_steps s on s.product_id = r.product_id and s.n = r.n + 1""")
oracle("stock_ledger", "select product_id, dt as date, stock as current_stock from ledger_days", "ledger_days")

# --- forecasts -------------------------------------------------------------------------------

oracle("forecast_daily", "select * from days where day_no <= 30", "days")
oracle("forecast_total", "select product_id, predicted as predicted_demand from predicted30", "predicted30")
oracle("forecast_noisy", "select * from noisy", "noisy")
oracle("forecast_band", "select *, round(quantity * 1.15e0, 6) as upper, round(quantity * 0.85e0, 6) as lower from days where day_no <= 30", "days")
define("tested", ["features"], """
  select f.product_id, f.dt as date, f.frame_no - trunc(f.frame_rows * 0.8e0)::bigint as step, f.frame_rows - trunc(f.frame_rows * 0.8e0)::bigint as steps,
    cast(f.quantity_sold as double) as y, cast(l.quantity_sold as double) as y_pred
  from features f join features l on f.product_id = l.product_id and l.frame_no = trunc(f.frame_rows * 0.8e0)
  where f.frame_no > trunc(f.frame_rows * 0.8e0)""")
oracle("naive_forecast", "select * from tested", "tested")
define("ar_rows", ["windows"], """
  select product_id, dt as date, list_concat([""" + ", ".join(f"x[{i}][1]" for i in range(1, 31)) + """], x[30][2:17], [1e0, quantity_sold]) as z,
    frame_no - 30 as seq_no, frame_rows - 30 as seq_rows, cast(floor((frame_rows - 30) * 0.8e0) as bigint) as split, lo, hi from windows""")
define("ar_upper", ["ar_rows"], """
  select product_id, pos, i, j, sum(z[i] * z[j]) as v
  from ar_rows, (select a.range as i, b.range as j, cast(row_number() over (order by a.range, b.range) - 1 as integer) as pos
    from range(1, 49) a, range(1, 49) b where a.range <= b.range)
  where seq_no <= split group by product_id, pos, i, j""")
oracle("ar_product_sums", "select product_id, pos, cast(floor(v * 1e6 + 0.1e0) as bigint) as millionths from ar_upper", "ar_upper")
# The normal equations with the ridge on their diagonal, solved by Gauss-Jordan elimination: 47 unknowns, column 48 is the right side.
define("ar_matrix", ["ar_upper"], f"""
  select product_id, i, j, v + case when i < j then 0e0 when i = 47 then 1e-9 else {RIDGE!r} end as v from ar_upper where i <= 47
  union all select product_id, j, i, v from ar_upper where i < j and j <= 47""")
define("gauss", ["ar_matrix"], """
  select product_id, 1 as k, i, j, v from ar_matrix
  union all
  select product_id, k + 1, i, j, case when i = k then v / diagonal else v - in_column * in_row / diagonal end
  from (select *, max(case when i = k and j = k then v end) over (partition by product_id) as diagonal,
      max(case when i = k then v end) over (partition by product_id, j) as in_row,
      max(case when j = k then v end) over (partition by product_id, i) as in_column
    from gauss where k <= 47)""")
define("ar_weights", ["gauss"], "select product_id, list(v order by i) as w from gauss where k = 48 and j = 48 group by product_id")
define("ar_tested", ["ar_rows", "ar_weights"], """
  select product_id, date, seq_no - split as step, seq_rows - split as steps, z[48] * (hi - lo) + lo as y,
    list_dot_product(z[1:47], w) * (hi - lo) + lo as y_pred
  from ar_rows join ar_weights using (product_id) where seq_no > split""")
oracle("ar_forecast", "select * replace (round(y, 3) as y, round(y_pred, 3) as y_pred) from ar_tested", "ar_tested")
# The reservoir's predictions are held against numpy loops in the tests; the days, the sales and its nearness can be foretold.
oracle("reservoir_forecast", """
  select product_id, count(*) as days, cast(round(sum(y)) as bigint) as sold, true as near from ar_tested group by product_id""", "ar_tested")
oracle("actual_vs_predicted", "select product_id, date, round(y, 2) as actual, round(y_pred, 2) as predicted from ar_tested", "ar_tested")
define("ar_ends", ["scaled", "ar_weights"], """
  select s.product_id, max(dt) as last_date, any_value(lo) as lo, any_value(hi) as hi, any_value(w) as w, list(quantity_sold order by frame_no) as past,
    any_value(w)[47] + list_dot_product(any_value(w)[31:46], max_by([""" + ", ".join(FEATURES[1:]) + """], frame_no)) as fixed
  from scaled s join ar_weights using (product_id) where frame_no > frame_rows - 30 and frame_rows >= 30 group by s.product_id""")
define("ar_steps", ["ar_ends"], """
  select product_id, 0 as day_no, past, 0e0 as value from ar_ends
  union all
  select product_id, day_no + 1, list_append(past[2:30], value), value
  from (select s.product_id, s.day_no, s.past, list_dot_product(s.past, e.w[1:30]) + e.fixed as value
    from ar_steps s join ar_ends e on s.product_id = e.product_id where s.day_no < 30)""")
define("ar_days", ["ar_steps", "ar_ends"], """
  select product_id, day_no, cast(last_date + day_no as date) as date,
    cast(trunc(greatest(value * (hi - lo) + lo, 0)) as bigint) as quantity
  from ar_steps join ar_ends using (product_id) where day_no > 0""")
oracle("ar_rollout", "select * from ar_days", "ar_days")


def define_scores(name: str, source: str, model: str) -> None:
    define(name, [source], f"""
      select product_id, '{model}' as model, count(*) as test_samples, round_even(avg(abs(y - y_pred)), 4) as mae,
        round_even(sqrt(avg((y - y_pred) * (y - y_pred))), 4) as rmse,
        round_even(avg(abs((y - y_pred) / y)) filter (where y <> 0) * 100, 2) as mape,
        round_even(avg(case when sign(dy) = sign(dp) then 1e0 when dy is not null then 0e0 end) * 100, 2) as directional_accuracy
      from (select *, y - lag(y) over w as dy, y_pred - lag(y_pred) over w as dp from {source} window w as (partition by product_id order by step))
      group by 1""")


define_scores("naive_scores", "tested", "Naive")
define_scores("ar_scores", "ar_tested", "AR")
oracle("forecast_metrics", "select * from naive_scores", "naive_scores")
define("scores", ["naive_scores", "ar_scores"], """
  select * from naive_scores union all select * from ar_scores
  union all select product_id, 'GBT', test_samples, null, null, null, null from naive_scores""")
oracle("comparison_scores", """
  select product_id, product_name, model, test_samples, 'evaluated' as status, round(mae, 2) as mae, round(rmse, 2) as rmse, round(mape, 2) as mape,
    round(directional_accuracy, 2) as directional_accuracy, true as holds from scores join catalog using (product_id)""", "scores", "catalog")
define("ranges", ["features"], """
  select product_id, count(*) as frame_rows, cast(max(quantity_sold) - min(quantity_sold) as double) as span from features group by 1""")
define("errors", ["ranges", "tested", "ar_tested"], """
  select product_id, model, frame_rows, count(*) as test_rows, avg((y - y_pred) / span * ((y - y_pred) / span)) as scaled_mse, avg(abs((y - y_pred) / span)) as scaled_mae
  from (select product_id, 'Naive' as model, y, y_pred from tested union all select product_id, 'AR', y, y_pred from ar_tested
    union all select product_id, 'GBT', y, null from tested) join ranges using (product_id) group by 1, 2, 3""")
oracle("training_record", """
  select product_id, model, 'evaluated' as status, test_rows as test_samples, frame_rows, frame_rows - test_rows as train_rows, test_rows,
    round(scaled_mse, 4) as scaled_mse, round(scaled_mae, 4) as scaled_mae from errors""", "errors")
oracle("selected_training", """
  select product_id, product_name, model, test_samples, 'evaluated' as status, round(mae, 2) as mae, round(rmse, 2) as rmse, round(mape, 2) as mape,
    round(directional_accuracy, 2) as directional_accuracy, true as holds
  from scores join catalog using (product_id) where category in ('fever', 'allergy')""", "scores", "catalog")
oracle("product_selection", """
  select w.product_id, case when c.product_id is null then 'unknown' else 'selected' end as status
  from (select distinct 'P' || lpad(cast(c_custkey % 40 as varchar), 3, '0') as product_id from customer) w left join catalog c using (product_id)""", "catalog")

# --- stock -----------------------------------------------------------------------------------

oracle("safety_stock", "select product_id, safety_stock from rec", "rec")
oracle("reorder_point", "select product_id, reorder_point from rec", "rec")
TURNOVER = "case when {d} >= 90 then 'Fast-Moving' when {d} <= 45 then 'Slow-Moving' else 'Normal' end"
oracle("turnover_class", f"select product_id, {TURNOVER.format(d='round_even(mean, 1)')} as turnover from trend", "trend")
oracle("recommend_stock", """
  select product_id, product_name, category, unit_price, season, predicted as predicted_demand, avg_daily_demand, lead_time_days, safety_stock,
    reorder_point, buffer_pct, buffer_units, recommended_stock, seasonal_factor from rec""", "rec")
oracle("recommend_all_seasons", """
  select product_id, season, buffer_pct, buffer_units, recommended_stock, seasonal_factor, current_stock, alert_type, severity, label, deficit, excess, message
  from alerted_seasons""", "alerted_seasons")
oracle("alert_cases", f"""
  select product_id, season, percent, {TURNOVER.format(d='avg_daily_demand')} as turnover, recommended_stock, reorder_point, current_stock, alert_type,
    severity, label, icon, deficit, excess, message from alerted_cases""", "alerted_cases")
oracle("alerts", """
  select product_id, product_name, alert_type, severity, label, icon, current_stock, recommended_stock, reorder_point, deficit, excess, message
  from alerted where alert_type is not null""", "alerted")
oracle("stock_status_table", f"""
  select product_id, product_name, {TITLE} as category, avg_daily_demand, predicted as predicted_demand, safety_stock, reorder_point,
    recommended_stock, current_stock, buffer_pct, seasonal_factor, {TURNOVER.format(d='avg_daily_demand')} as turnover,
    coalesce(label, '✅ Healthy') as status from alerted""", "alerted")
oracle("overview_kpis", """
  select count(*) as products, cast(sum(predicted) as bigint) as total_forecast, count(*) filter (where severity in ('critical', 'warning')) as low_stock_alerts,
    count(*) filter (where alert_type = 'OVERSTOCK') as overstock_alerts, round_even(avg(seasonal_factor), 2) as avg_seasonal_factor from alerted""", "alerted")
oracle("business_kpis", """
  select round_even(count(*) filter (where severity in ('critical', 'warning')) / count(*)::double * 100, 1) as stockout_risk_pct,
    round_even(count(*) filter (where alert_type = 'OVERSTOCK') / count(*)::double * 100, 1) as overstock_pct,
    round_even((select sum(current_stock) from inventory)::double / greatest(1, sum(predicted)) * 30, 1) as coverage_days,
    cast(sum(recommended_stock) as bigint) as total_recommended, (select cast(sum(current_stock) as bigint) from inventory) as total_current,
    round_even(avg(seasonal_factor), 2) as avg_seasonal_factor from alerted""", "alerted", "inventory")
define("demand_model", ["predicted30", "trend", "now_season", "catalog", "ar_days"], """
  select p.product_id, coalesce(r.total, p.predicted) as predicted, t.mean, s.season, case when r.total is null then 'trend' else 'AR' end as model_type
  from predicted30 p join trend t using (product_id)
    left join (select product_id, cast(sum(quantity) as bigint) as total from ar_days join catalog using (product_id) where category <> 'diabetes' group by 1) r
    using (product_id), now_season s""")
define_recommendation("_model", "demand_model")
oracle("model_first_forecast", """
  select product_id, model_type, season, predicted as predicted_demand, safety_stock, reorder_point, recommended_stock from rec_model""", "rec_model")
oracle("inventory_status", f"""
  select product_id, product_name, current_stock, recommended_stock, safety_stock, reorder_point, {TURNOVER.format(d='avg_daily_demand')} as turnover,
    case when share < 0.5e0 then 'Critical' when share < 0.8e0 then 'Low' when share > 1.3e0 then 'Overstock' else 'OK' end as status from alerted""", "alerted")
oracle("stock_vs_recommended", "select product_name, current_stock, recommended_stock, reorder_point from alerted", "alerted")
oracle("forecast_kpis", """
  select product_id, horizon, predicted as predicted_demand, recommended_stock, safety_stock, reorder_point, buffer_pct, seasonal_factor,
    cast(trunc(mean_quantity) as bigint) as avg_forecast from rec_spans""", "rec_spans")

# --- inventory -------------------------------------------------------------------------------

oracle("inventory_defaults", "select product_id, base_demand * 30 as current_stock, cast(null as timestamp) as last_updated from catalog", "catalog")
for name in ("inventory_upsert", "inventory_stream"):
    oracle(name, "select * from inventory", "inventory")
oracle("inventory_levels", "select product_id, current_stock from inventory", "inventory")
oracle("inventory_backfill", """
  select coalesce(n.product_id, c.product_id) as product_id, coalesce(n.quantity, c.base_demand * 30) as current_stock, n.ts as last_updated
  from catalog c full join (select product_id, greatest(0, arg_max(new_quantity, (ts, new_quantity))) as quantity, max(ts) as ts
    from counts where category <> 'diabetes' group by 1) n using (product_id)""", "catalog", "counts")

# --- reports ---------------------------------------------------------------------------------

for span, source in ((30, "alerted"), (7, "alerted7"), (60, "alerted60")):
    FORECAST_REPORT = f"""
      select product_id, product_name, {TITLE} as category, unit_price, {span} as horizon_days, predicted as forecast, avg_daily_demand, safety_stock,
        reorder_point, recommended_stock, buffer_pct, seasonal_factor, lead_time_days, current_stock from {source}"""
    for name in ("forecast_report", "export_csv") if span == 30 else (f"forecast_report_{span}",):
        oracle(name, FORECAST_REPORT, source)
define("alert_lines", ["alerted"], """
  select product_name as product, alert_type, severity, current_stock, recommended_stock, reorder_point, coalesce(deficit, excess) as deficit_or_excess,
    cast(null as varchar) as status, message from alerted where alert_type is not null""")
oracle("alerts_report", """
  select * from alert_lines union all
  select null, null, null, null, null, null, null, 'All products healthy', 'No alerts generated.' where not exists (select 1 from alert_lines)""", "alert_lines")
define("report_lines", ["features", "catalog"], """
  select f.date, f.product_id, c.product_name, upper(c.category[1]) || c.category[2:] as category, f.season, f.quantity_sold, round(f.revenue, 2) as revenue
  from features f join catalog c on f.product_id = c.product_id""")
oracle("daily_sales_report", "select * from report_lines", "report_lines")
oracle("daily_sales_tail", "select * from report_lines order by product_id desc, date desc limit 200", "report_lines")
oracle("export_report", """
  select 'Forecasts' as sheet, count(*) as lines from rec union all
  select 'Alerts', greatest(1, count(*)) from alert_lines union all select 'Daily Sales', count(*) from report_lines""", "rec", "alert_lines", "report_lines")

for name in (
    "scan_sales calendar_features week_cyclical season_features peak_season_flag lag_features rolling_stats "
    "rolling_stats_shifted feature_vector tabular_features eda_moving_average last_n_history minmax_scaled "
    "inverse_scaled sequence_windows stock_ledger forecast_daily forecast_noisy forecast_band naive_forecast "
    "ar_forecast ar_rollout actual_vs_predicted"
).split():
    as_text(name, "date")
as_text("chrono_split", "last_train_date")
as_text("training_sets", "date_from", "date_to")
