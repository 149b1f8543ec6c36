"""Statistics that need no state: intervals, guarded ratios, classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of a rate; null where n is 0."""
    p = F.try_divide(hits.cast("double"), n.cast("double"))
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = n > 0
    return F.when(some, middle - half), F.when(some, middle + half)


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(otherwise))


def percent_clipped(a: Column, b: Column) -> Column:
    """100 a / b to one decimal, at most 100; 0 where b is 0."""
    return F.when(b > 0, F.least(F.bround(100.0 * a / b, 1), F.lit(100.0))).otherwise(0.0)


def scaled_round(x: Column, digits: int) -> Column:
    """A double rounded half away from zero after scaling by a power of ten (F.round goes by its shortest decimal form)."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def cents_even(x: Column) -> Column:
    """A double to two decimals, half to even after scaling (F.bround goes by its shortest decimal form)."""
    return F.rint(x * 100.0) / 100.0


def price_class(now: Column, mean: Column) -> Column:
    """Order matters: over 5 x and 50 above is a leak, over 2 x or under half is drift, else real."""
    return F.when((now > 5 * mean) & (now - mean > 50), "leak").when((now > 2 * mean) | (now < 0.5 * mean), "drift").otherwise("real")


def invoice_status(items: Column, total: Column, credits: Column, tolerance: float = 0.5, percent: float = 1.0, fees: Column | None = None, n_items: Column | None = None) -> Column:
    """pass, review, fail or partial, from the gap between a printed total and its lines.

    It passes when the gap is within the tolerance, when credits explain it, when it is within a percentage, or when
    known fees explain it and there are items at all.
    """
    gap = total - items
    paths = [F.abs(gap) <= tolerance, F.abs(gap - credits) <= tolerance, F.abs(gap) <= F.abs(total) * percent / 100]
    if fees is not None:
        paths.append((F.abs(gap - fees) <= tolerance) & ((n_items > 0) if n_items is not None else F.lit(True)))
    ok = F.lit(False)
    for p in paths:
        ok = ok | F.coalesce(p, F.lit(False))
    return F.when(total.isNull(), "partial").when(ok, "pass").when(F.abs(gap) <= F.abs(total) * 5 / 100, "review").otherwise("fail")
