"""Number and table rules shared by the other expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def whole(value: Column) -> Column:
    """Drop the fraction, towards zero."""
    return value.cast("long")


def half_even(value: Column, digits: int = 0) -> Column:
    """Round a display figure; exact halves go to the even neighbour."""
    return F.bround(value, digits)


def grouped(value: Column) -> Column:
    """Whole number as text with thousands separators."""
    return F.format_number(value, 0)


def literal(value) -> str:
    """A value as SQL text; fractions are doubles, never decimals."""
    if value is None:
        return "null"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def lookup_text(key: str, table: dict, default) -> str:
    """Value of a small fixed table as CASE text: no join, stays in generated code.

    ``key`` is SQL text. A table key that is a tuple stands for each of its members.
    """
    def members(name) -> str:
        return ", ".join(literal(n) for n in (name if isinstance(name, tuple) else (name,)))

    branches = " ".join(f"when {key} in ({members(name)}) then {literal(value)}" for name, value in table.items())
    return f"case {branches} else {literal(default)} end"


def lookup(key: str, table: dict, default) -> Column:
    return F.expr(lookup_text(key, table, default))


def ratio(part: Column, total: Column, when_zero: float | None = None) -> Column:
    """part / total as double; ``when_zero`` where the total is 0."""
    return F.when(total != 0, part.cast("double") / total.cast("double")).otherwise(F.lit(when_zero).cast("double"))
