"""DuckDB texts shared by the oracle queries: the sales fact and what is derived from it.

Written from the rules, not from the Spark code. All texts are CTE bodies, combined by ``with_ctes``.
"""

from __future__ import annotations

SEASON = """case when month({d}) in (3,4,5) then 'Summer' when month({d}) in (6,7,8,9) then 'Monsoon'
    when month({d}) in (10,11) then 'Post-Monsoon' else 'Winter' end"""

FACTOR = """case when {s}='Monsoon' and {c}='fever' then 1.8e0 when {s}='Monsoon' and {c}='hydration' then 1.6e0
    when {s}='Monsoon' and {c}='antibiotic' then 1.5e0 when {s}='Monsoon' and {c}='allergy' then 1.3e0
    when {s}='Winter' and {c}='respiratory' then 1.7e0 when {s}='Winter' and {c}='fever' then 1.4e0
    when {s}='Winter' and {c}='supplement' then 1.3e0 when {s}='Summer' and {c}='hydration' then 1.9e0
    when {s}='Summer' and {c}='painkiller' then 1.2e0 when {s}='Post-Monsoon' and {c}='allergy' then 1.4e0
    else 1.0e0 end"""

PEAK = """case when ({s},{c}) in (('Monsoon','fever'),('Monsoon','antibiotic'),('Monsoon','hydration'),
    ('Winter','respiratory'),('Winter','fever'),('Summer','hydration'),('Post-Monsoon','allergy'))
    then 1 else 0 end"""

CTES: dict[str, str] = {}

CTES["daily"] = """
  select p_brand as brand, cast(l_shipdate as date) as d, sum(l_quantity) as units, max(p_retailprice) as price,
         cast(split_part(p_brand, '#', 2) as integer) as num
  from lineitem join part on l_partkey = p_partkey group by 1, 2"""

CTES["sold"] = """
  select *, cast(units as bigint) * (1 + num % 4) as q, 3 + num % 5 as lead_days,
    (['fever','hydration','respiratory','allergy','antibiotic','supplement','painkiller','diabetes'])[1 + num % 8] as cat
  from daily"""

CTES["catalog"] = """
  select 'P' || lpad(cast(num as varchar), 3, '0') as product_id, brand as product_name, cat as category,
    cast(floor(cast(sum(q) as bigint) / count(*)) as integer) as base_demand, max(price) as unit_price,
    cast(lead_days as integer) as lead_time_days
  from sold group by num, brand, cat, lead_days"""

CTES["flow"] = f"""
  select s.d, c.*, s.q, {SEASON.format(d='s.d')} as season,
    row_number() over (partition by c.product_id order by s.d) - 1 as day_no
  from sold s join catalog c on c.product_name = s.brand"""

CTES["flow2"] = f"""
  select *, {FACTOR.format(s='season', c='category')} as mult from flow"""

CTES["flow3"] = """
  select *, base_demand * 45 + sum(case when day_no % lead_time_days = 0
      then cast(floor(base_demand * mult * lead_time_days * (0.6e0 + 0.1e0 * (lead_time_days - 3))) as bigint)
      else 0 end - q) over (partition by product_id order by d rows unbounded preceding) as s
  from flow2"""

CTES["flow4"] = """
  select *, s - least(0, min(s) over (partition by product_id order by d rows unbounded preceding)) as stock
  from flow3"""

CTES["sales"] = """
  select strftime(d, '%Y-%m-%d') as date, 'STORE_001' as store_id, product_id, product_name, category, season,
    cast(q as integer) as quantity_sold, unit_price, round(q * unit_price, 2) as revenue,
    cast(stock as integer) as current_stock, lead_time_days,
    case when stock > base_demand * mult * 60 then 1 else 0 end as expiry_risk,
    case when month(d) in (1,3,8,9,10,11) then 1 else 0 end as is_festival_month
  from flow4"""

NEEDS = {
    "daily": [], "sold": ["daily"], "catalog": ["sold"], "flow": ["sold", "catalog"], "flow2": ["flow"],
    "flow3": ["flow2"], "flow4": ["flow3"], "sales": ["flow4"],
}


def define(name: str, needs: list[str], body: str) -> None:
    CTES[name], NEEDS[name] = body, needs


def with_ctes(query: str, *names: str) -> str:
    """``query`` preceded by the named CTEs and all they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS[name]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = ",\n".join(f"{n} as ({CTES[n]})" for n in ordered)
    recursive = any(f"from {n} " in CTES[n] for n in ordered)
    return f"with {'recursive ' if recursive else ''}{parts}\n{query}"
