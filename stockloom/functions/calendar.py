"""Calendar, season and festival expressions. Arguments are column names or SQL text."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, functions as F

from stockloom import rules
from stockloom.functions.numeric import literal, lookup, lookup_text


def _season_text(month: str) -> str:
    return lookup_text(month, {months: season for season, months in rules.SEASON_MONTHS.items()}, rules.UNKNOWN_SEASON)


def season_of_month(month: str) -> Column:
    return F.expr(_season_text(month))


def season_of_date(date: str) -> Column:
    """Season of a date, a timestamp or ``yyyy-MM-dd`` text."""
    return season_of_month(f"month({date})")


def season_code(season: str) -> Column:
    return lookup(season, rules.SEASON_CODES, 0)


def festival_flag(month: str) -> Column:
    return lookup(month, {rules.FESTIVAL_MONTHS: 1}, 0)


def peak_season_flag(season: str, category: str) -> Column:
    pairs = " or ".join(
        f"({season} = {literal(peak)} and {category} = {literal(kind)})" for peak, kind in rules.PEAK_SEASONS
    )
    return F.expr(f"case when {pairs} then 1 else 0 end")


def week_wave(date: str, wave: str) -> Column:
    """sin or cos over the ISO week; week 53 is not wrapped."""
    return F.expr(f"{wave}({literal(2 * pi)} * weekofyear({date}) / 52.0D)")


def calendar_columns(date: str) -> dict[str, Column]:
    """Calendar features of a date, Monday being day 0."""
    return {
        "month": F.expr(f"month({date})"),
        "day_of_week": F.expr(f"weekday({date})"),
        "day_of_month": F.expr(f"dayofmonth({date})"),
        "quarter": F.expr(f"quarter({date})"),
        "is_weekend": F.expr(f"int(weekday({date}) >= 5)"),
        "week_sin": week_wave(date, "sin"),
        "week_cos": week_wave(date, "cos"),
    }


def season_columns(date: str) -> dict[str, Column]:
    """Season, its code and the festival flag, all taken from the month of the date."""
    month = f"month({date})"
    return {
        "season": season_of_month(month),
        "season_encoded": season_code(f"({_season_text(month)})"),
        "is_festival_month": festival_flag(month),
    }
