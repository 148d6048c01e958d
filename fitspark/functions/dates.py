"""Dates, decay and guarded numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitspark.functions import arrays


def parse_date(c: Column) -> Column:
    """The date in the first ten characters, padded or not; null if there is none."""
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-M-d")


def months(start: Column, end: Column) -> Column:
    """Months from start to end, a day counting a thirtieth. Not months_between(), which counts days otherwise."""
    return (F.year(end) - F.year(start)) * 12.0 + (F.month(end) - F.month(start)) + (F.day(end) - F.day(start)) / F.lit(30.0)


def months_since(end: Column, is_current: Column, ref: Column) -> Column:
    """Months since a job ended; 0 while it goes on, or if its end is unknown or ahead."""
    day = parse_date(F.nullif(end, F.lit("")))
    # The text is parsed once, though months() takes the date apart.
    return arrays.bound(day, lambda d: F.when(~F.coalesce(is_current, F.lit(False)) & d.isNotNull(), F.greatest(F.lit(0.0), months(d, ref))).otherwise(F.lit(0.0)))


def half_life(age: Column, half: float) -> Column:
    return F.pow(F.lit(0.5), age / half)


def gaussian(x: Column, peak: float, sigma: float) -> Column:
    return F.exp(-F.pow(x - peak, F.lit(2.0)) / (2 * sigma * sigma))


def first_rung(x: Column, rungs: list[tuple[float, float]]) -> Column:
    """As-of lookup forward: the multiplier of the first rung (limit, mult) with x <= limit, else of the last."""
    out = F.lit(float(rungs[-1][1]))
    for limit, mult in reversed(rungs):
        out = F.when(x <= limit, F.lit(float(mult))).otherwise(out)
    return out


def last_rung(x: Column, rungs: list[tuple[float, float]]) -> Column:
    """As-of lookup backward: the multiplier of the greatest rung (limit, mult) with x > limit, else 1."""
    out = F.lit(1.0)
    for limit, mult in sorted(rungs):
        out = F.when(x > limit, F.lit(float(mult))).otherwise(out)
    return out


def clip(x: Column, low: float, high: float) -> Column:
    """The value within bounds; null becomes the lower one."""
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def number_or(x: Column, default: float) -> Column:
    """The value as a finite number, else the default."""
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(float(default))).otherwise(d)


def clamp_int(x: Column, low: int, high: int, default: int) -> Column:
    """Rounded half to even and clamped; the default if it is no number."""
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit(default)).otherwise(clip(F.bround(d), low, high).cast("int"))
