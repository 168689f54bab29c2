"""Rounding, ramps and shares as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole; 0 where there is nothing to share."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def ramp(x: Column, lo: float, hi: float) -> Column:
    """0 at ``lo``, 1 at ``hi``, clamped; a step where they are equal."""
    if lo == hi:
        return F.when(x >= hi, 1.0).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / F.lit(float(hi - lo))))


def falling(x: Column, good: float, bad: float) -> Column:
    """1 at ``good``, 0 at ``bad``, clamped."""
    return ramp(-x, -bad, -good)


def plateau(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Rises from a to b, holds to c, falls to d."""
    return F.when(x < b, ramp(x, a, b)).when(x <= c, 1.0).otherwise(falling(x, c, d))


def tenths(fraction: Column, points: float) -> Column:
    """Tenths of a point, half up."""
    return F.floor(fraction * F.lit(float(points)) * 10 + 0.5).cast("long")


def half_up(x: Column, places: int = 0, as_double: bool = True) -> Column:
    """Rounded by the shortest decimal text, halves away from zero: 1.005 gives 1.01, 2.675 gives 2.68."""
    out = F.round(x.cast("double").cast("string").cast("decimal(38,17)"), places)
    return out.cast("double") if as_double else out


def fill_percent(part: Column, whole: Column) -> Column:
    """A share in per cent between 0 and 100, to a tenth; 0 where there is nothing to fill."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(part, whole)))
    return F.when((whole > 0) & ~F.isnan(part) & (F.abs(part) < float("inf")), half_up(clamped * 100, 1)).otherwise(F.lit(0.0))


def sum_sorted(values: Column) -> Column:
    """The sum of an array in ascending order, which doesn't depend on the order of its elements."""
    return F.aggregate(F.array_sort(values), F.lit(0.0), lambda total, x: total + x)


def bisect_left(values: Column, x: Column) -> Column:
    """How many elements of an ascending array are smaller: found by halving, a step a power of two."""
    return _bisected(values, lambda at: at < x)


def bisect_right(values: Column, x: Column) -> Column:
    """How many elements of an ascending array are not larger."""
    return _bisected(values, lambda at: at <= x)


def _bisected(values: Column, before) -> Column:
    steps = F.reverse(F.sequence(F.lit(0), F.lit(30)))
    bit = lambda i: F.pow(F.lit(2), i).cast("int")
    n = F.size(values)
    return F.aggregate(steps, F.lit(0), lambda at, i: F.when((at + bit(i) <= n) & before(F.get(values, at + bit(i) - 1)), at + bit(i)).otherwise(at))


def try_int(text: Column, default: int = 0) -> Column:
    """A whole number with optional sign; ``default`` for anything else."""
    t = F.trim(text)
    return F.coalesce(F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long")), F.lit(default))


def try_float(text: Column) -> Column:
    """A number, an infinity or nan in text; null for anything else."""
    t = F.trim(text)
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    endless = F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(t.rlike("(?i)^[+-]?inf(inity)?$"), endless).when(t.rlike("(?i)^[+-]?nan$"), F.lit(float("nan"))).otherwise(plain)
