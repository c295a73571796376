"""Missing values: NULL and nothing else. NaN and infinities become NULL at every boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def observed(x: Column, m: Column) -> Column:
    return F.when(m, x)


def to_percent(y: Column, base: Column, mode: str = "delta_over_baseline") -> Column:
    """Change against a baseline in percent, or ratio in percent; NULL for a missing or zero baseline."""
    if mode not in ("delta_over_baseline", "ratio"):
        raise ValueError(mode)
    value = 100.0 * ((y - base) / base) if mode == "delta_over_baseline" else 100.0 * (y / base)
    return F.when(base.isNotNull() & (base != 0), finite(value))


def statistic(x: Column, name: str) -> Column:
    """mean, median, max or min of the values that are there."""
    made = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}
    if name not in made:
        raise ValueError(f"unknown statistic {name}")
    return made[name](x)


def soft_threshold(y: Column, tau: float) -> Column:
    return F.signum(y) * F.greatest(F.abs(y) - tau, F.lit(0.0))


def decibel(ratio: Column) -> Column:
    return F.when(ratio > 0, 10.0 * F.log10(ratio))
