"""Order statistics of sliding frames from one sorted window that samples enter and leave: n log w steps where sorting each frame anew
takes n w log w. A group is one series; Spark deals and shuffles them."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nearest(s: list[float], centre: float, k: int) -> float:
    """The k-th smallest (from 0) distance of sorted values to the centre: the k nearest form a run, whose start is found by halving."""
    n = len(s)
    low, high = 0, n - k - 1
    while low < high:  # the run of k + 1 values that holds the nearest ones
        mid = (low + high) // 2
        if centre - s[mid] > s[mid + k + 1] - centre:
            low = mid + 1
        else:
            high = mid
    return max(centre - s[low], s[low + k] - centre)


def frames(y: np.ndarray, first: int, last: int, deviation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(median, median distance from it, number) of the values that are there from ``first`` to ``last`` around each, short at the ends."""
    n = len(y)
    values, there = y.tolist(), np.isfinite(y).tolist()
    window: list[float] = []
    low = high = 0
    medians, spreads, counts = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, np.int64)
    for i in range(n):
        begin, end = min(max(i + first, 0), n), min(max(i + last + 1, 0), n)
        while high < end:
            if there[high]:
                insort(window, values[high])
            high += 1
        while low < begin:
            if there[low]:
                del window[bisect_left(window, values[low])]
            low += 1
        m = len(window)
        if m:
            counts[i] = m
            medians[i] = mid = (window[(m - 1) // 2] + window[m // 2]) / 2
            if deviation:
                far = _nearest(window, mid, m // 2)
                spreads[i] = far if m % 2 else (_nearest(window, mid, m // 2 - 1) + far) / 2
    return medians, spreads, counts


def padded(y: np.ndarray, w: int) -> np.ndarray:
    """Centred medians over w samples, w odd, with the end values repeated beyond the ends."""
    if w % 2 == 0:
        raise ValueError("the window must be odd")
    h = w // 2
    return frames(np.concatenate([np.repeat(y[:1], h), y, np.repeat(y[-1:], h)]), -h, h)[0][h : h + len(y)]


def hampel(y: np.ndarray, k: int = 5, n_sigmas: float = 3.0, to_null: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(values, outliers): values further than ``n_sigmas`` scaled median deviations from their frame's median are replaced by it."""
    mid, spread, n = frames(y, -k, k, deviation=True)
    sigma = 1.4826 * spread
    with np.errstate(invalid="ignore"):
        odd = np.isfinite(y) & (n >= 3) & (sigma > 0) & (np.abs(y - mid) > n_sigmas * sigma)
    return np.where(odd, np.nan if to_null else mid, y), odd


def by_series(df: DataFrame, by: list[str], value: str, run: Callable[[np.ndarray], np.ndarray], order: str = "t_idx") -> DataFrame:
    """df with ``value`` replaced by ``run`` of each series in order; NULL and NaN are missing. Other columns stay."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        found = run(g[value].to_numpy(float))
        return g.assign(**{value: pd.Series(found, index=g.index).where(np.isfinite(found), None).astype(float)})

    out = df.withColumn(value, F.col(value).cast("double"))
    made = out.groupBy(*by).applyInPandas(one, out.schema)
    return made.withColumn(value, F.when(~F.isnan(value), F.col(value)))
