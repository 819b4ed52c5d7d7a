"""Stock alert rules: the first rule that holds names the alert."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stockloom import rules
from stockloom.functions.numeric import col, grouped, half_even, lookup, ratio


def alert_type(stock: Column, recommended: Column, reorder: Column, factor: Column) -> Column:
    """Alert type, null for healthy stock and where nothing is recommended."""
    share = ratio(stock, recommended)
    return (
        F.when(recommended == 0, F.lit(None).cast("string"))
        .when(share < rules.CRITICAL_RATIO, "CRITICAL")
        .when((factor > rules.SEASONAL_RISK_FACTOR) & (share < rules.SEASONAL_RISK_RATIO), "SEASONAL_RISK")
        .when(stock <= reorder, "RESTOCK_SOON")
        .when(share < rules.LOW_RATIO, "LOW_STOCK")
        .when(share > rules.OVERSTOCK_RATIO, "OVERSTOCK")
    )


def _kind_part(kind: str, position: int) -> Column:
    return lookup(kind, {name: parts[position] for name, parts in rules.ALERT_KINDS.items()}, None)


def severity_rank(severity: str) -> Column:
    return lookup(severity, rules.SEVERITY_RANKS, 3)


def alert_details(
    kind_name: str, stock: Column | str, recommended: Column | str, reorder: Column | str, factor: Column | str
) -> dict[str, Column]:
    """The other fields of the alert record; they are null where the alert type ``kind_name`` is."""
    kind, stock, recommended, reorder, factor = map(col, (kind_name, stock, recommended, reorder, factor))
    gap = recommended - stock
    percent = half_even(ratio(stock, recommended) * F.lit(100), 0).cast("long").cast("string")
    slots = {
        "CRITICAL": (percent, grouped(gap)),
        "SEASONAL_RISK": (percent, factor.cast("string")),
        "RESTOCK_SOON": (grouped(reorder), grouped(gap)),
        "LOW_STOCK": (percent,),
        "OVERSTOCK": (grouped(-gap),),
    }
    message = F
    for name, values in slots.items():
        message = message.when(kind == name, F.format_string(rules.ALERT_TEXTS[name], *values))
    return {
        "severity": _kind_part(kind_name, 0),
        "label": _kind_part(kind_name, 1),
        "icon": _kind_part(kind_name, 2),
        "deficit": F.when(kind != "OVERSTOCK", gap),
        "excess": F.when(kind == "OVERSTOCK", -gap),
        "message": message.otherwise(None),
    }
