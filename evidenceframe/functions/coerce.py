"""Lenient casts and divisions: text cells to numbers, with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """NULL for empty or all-blank text."""
    text = F.trim(col(c).cast("string"))
    return F.when(text != "", text)


def safe_float(c: Column | str, default: float = 0.0) -> Column:
    """The number in a cell; default where there is none."""
    return F.coalesce(blank_to_null(c).try_cast("double"), F.lit(float(default)))


def safe_int(c: Column | str, default: int = 0) -> Column:
    """The number truncated toward zero; default where there is none or it isn't finite."""
    x = blank_to_null(c).try_cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) < 9.2e18), x)
    return F.coalesce(finite.cast("bigint"), F.lit(default).cast("bigint"))


def safe_div(num: Column | str, den: Column | str) -> Column:
    """num / den; 0 where den is 0."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))


def flag(c: Column | str) -> Column:
    """Text or boolean to boolean: true only for 'true' in any case."""
    return F.coalesce(F.lower(col(c).cast("string")) == "true", F.lit(False))


def first_present(*cells: Column | str) -> Column:
    """The first cell that holds text."""
    return F.coalesce(*(blank_to_null(c) for c in cells))
