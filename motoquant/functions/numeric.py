"""Rounding, clipping and safe casts that agree with the usual dataframe conventions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``.

    A Column used five times is computed five times wherever common subexpressions are not
    shared, as in a pushed-down filter or behind a condition. Bound as a lambda variable it is
    computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def round_even(x: Column | str, digits: int = 0) -> Column:
    """Half-to-even on the double itself; ``bround`` would round the printed decimal instead."""
    c = _c(x).cast("double")
    if digits == 0:
        return F.rint(c)
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale


def round_int(x: Column | str) -> Column:
    return F.rint(_c(x).cast("double")).cast("bigint")


def clip(x: Column | str, low: float, high: float) -> Column:
    """Bound a value, keeping null as null (``least``/``greatest`` alone would drop the null)."""
    c = _c(x)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def to_number(x: Column | str) -> Column:
    """Text to double; anything unparseable, NaN or infinite becomes null."""
    c = _c(x).cast("string")
    return F.when(c.rlike(r"[0-9.]\s*$"), c.try_cast("double"))


def to_int(x: Column | str) -> Column:
    return _c(x).try_cast("bigint")


def null_if_nan(x: Column | str) -> Column:
    c = _c(x)
    return F.when(~F.isnan(c), c)


def first_match(x: Column | str, pattern: str, group: int = 1) -> Column:
    """Capture group of the first regex match, null when there is none."""
    c = _c(x)
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def number_match(x: Column | str, pattern: str) -> Column:
    return first_match(x, pattern).try_cast("double")


def rint_sum(x: Column, digits: int = 4) -> Column:
    """Sum of doubles rounded so that the order of addition does not show."""
    return round_even(F.sum(x), digits)
