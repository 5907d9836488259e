"""Number helpers: the two roundings, lenient parsing, blank tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounds halves to the even neighbour."""
    return F.bround(c, digits)


def half_up(c: Column) -> Column:
    """Rounds halves up, to a whole number."""
    return F.floor(c + F.lit(0.5))


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, whatever the number of its uses."""
    return F.transform(F.array(value), body)[0]


def nonzero(c: Column) -> Column:
    """Null for zero."""
    return F.nullif(c.cast("double"), F.lit(0.0))


def number(c: Column) -> Column:
    """A double from text that may hold a percent sign; null if it is none, not finite or blank."""
    got = F.regexp_replace(F.trim(c.cast("string")), "%", "").try_cast("double")
    return F.when(~F.isnan(got) & (F.abs(got) != F.lit(float("inf"))), got)


def usable_text(c: Column) -> Column:
    """Trimmed text; null if it is blank or spells a missing value."""
    text = F.trim(c.cast("string"))
    return F.when((text != "") & ~F.lower(text).isin("nan", "nat", "none", "null"), text)


def is_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def is_missing(c: Column) -> Column:
    """Null, NaN or infinite, of a double."""
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def first_present(df_columns: list[str], names: list[str], clean) -> Column:
    """The first clean value of the columns of `names` that there are; null if there is none."""
    found = [clean(F.col(f"`{n}`")) for n in names if n in df_columns]
    return F.coalesce(*found) if found else F.lit(None)


def percent(c: Column) -> Column:
    """Yield in percent points: null is 0, a fraction of 0 to 1 is multiplied by 100; four places."""
    return F.coalesce(half_even(F.when((c >= 0) & (c <= 1), c * 100).otherwise(c), 4), F.lit(0.0))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
