"""Replenishment rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stockloom import rules
from stockloom.functions.numeric import col, half_even, literal, lookup, ratio, whole


def seasonal_factor(season: str, category: str, factors: dict | None = None) -> Column:
    """Demand factor of a category in a season. Arguments are column names or SQL text."""
    branches = " ".join(
        f"when {season} = {literal(peak)} and {category} = {literal(kind)} then {literal(value)}"
        for (peak, kind), value in (factors or rules.SEASONAL_FACTORS).items()
    )
    return F.expr(f"case {branches} else 1.0D end")


def season_buffer(season: str, factor: Column, buffers: dict | None = None) -> Column:
    """Buffer share of the season; strong seasonal products get a little more."""
    base = lookup(season, buffers or rules.SEASON_BUFFERS, rules.DEFAULT_BUFFER)
    return F.when(factor > rules.PEAK_FACTOR, base + F.lit(rules.PEAK_BUFFER_EXTRA)).otherwise(base)


def safety_stock(daily: Column | str, lead: Column | str, factor: float = rules.SAFETY_FACTOR) -> Column:
    return F.greatest(F.lit(1).cast("long"), whole(col(daily) * col(lead) * F.lit(factor)))


def reorder_point(daily: Column | str, lead: Column | str, safety: Column | None = None) -> Column:
    kept = safety_stock(daily, lead) if safety is None else safety
    return whole(col(daily) * col(lead)) + kept


def turnover_class(daily: Column | str, fast: float = rules.FAST_UNITS, slow: float = rules.SLOW_UNITS) -> Column:
    return F.when(col(daily) >= fast, "Fast-Moving").when(col(daily) <= slow, "Slow-Moving").otherwise("Normal")


def expiry_flag(stock: Column | str, base: Column | str, factor: Column) -> Column:
    """More stock than the seasonal base demand sells in the expiry span."""
    return (col(stock) > col(base) * factor * F.lit(rules.EXPIRY_DAYS)).cast("int")


def shelf_status(stock: Column | str, recommended: Column | str) -> Column:
    """Traffic light of the stock editor, which knows no reorder point."""
    share = ratio(col(stock), col(recommended), 1.0)
    return (
        F.when(share < rules.CRITICAL_RATIO, "Critical")
        .when(share < rules.LOW_RATIO, "Low")
        .when(share > rules.OVERSTOCK_RATIO, "Overstock")
        .otherwise("OK")
    )


def recommendation(
    predicted: Column | str,
    season: str,
    category: str,
    daily: Column | str | None = None,
    lead: Column | str | None = None,
) -> dict[str, Column]:
    """The recommendation record. Daily demand defaults to predicted / 30, lead time to 5 days."""
    predicted = col(predicted)
    daily = predicted / F.lit(30.0) if daily is None else col(daily)
    lead = F.lit(rules.DEFAULT_LEAD_DAYS) if lead is None else F.coalesce(col(lead), F.lit(rules.DEFAULT_LEAD_DAYS))
    factor = seasonal_factor(season, category)
    buffer = season_buffer(season, factor)
    safety = safety_stock(daily, lead)
    units = F.greatest(safety, whole(predicted * buffer))
    return {
        "predicted_demand": whole(predicted),
        "avg_daily_demand": half_even(daily, 1),
        "lead_time_days": lead,
        "safety_stock": safety,
        "reorder_point": reorder_point(daily, lead, safety),
        "buffer_pct": half_even(buffer * F.lit(100), 1),
        "buffer_units": units,
        "recommended_stock": whole(predicted) + units,
        "seasonal_factor": half_even(factor, 2),
    }
