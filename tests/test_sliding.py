"""Sorted windows against frames that are sorted anew, on arrays and on tables, and how long they take."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwave.operators import sequences as S
from maskwave.operators import sliding as L


def series(n, seed=0, gone=0.15, ties=True):
    rng = np.random.default_rng(seed)
    y = rng.normal(100, 3, n)
    y = np.round(y) if ties else y
    y[rng.random(n) < gone] = np.nan
    return y


def plain(y, first, last):
    out = []
    for i in range(len(y)):
        part = y[max(0, min(i + first, len(y))) : max(0, i + last + 1)]
        part = part[np.isfinite(part)]
        mid = np.median(part) if len(part) else np.nan
        out.append((mid, np.median(np.abs(part - mid)) if len(part) else np.nan, len(part)))
    return [np.array(c) for c in zip(*out, strict=True)]


@pytest.mark.parametrize(("first", "last"), [(-5, 5), (-50, 50), (-100, 0), (7, 40), (-3, -1), (0, 0), (30, 90)])
@pytest.mark.parametrize("ties", [True, False])
def test_frames(first, last, ties):
    for n in (1, 2, 60, 300):
        y = series(n, n, ties=ties)
        for got, want in zip(L.frames(y, first, last, True), plain(y, first, last), strict=True):
            np.testing.assert_allclose(got, want, rtol=1e-12)
    assert len(L.frames(np.zeros(0), -1, 1)[0]) == 0


def test_padded_and_hampel():
    y = series(200, 4, gone=0.0, ties=False)
    h = 20
    wide = np.concatenate([np.repeat(y[0], h), y, np.repeat(y[-1], h)])
    np.testing.assert_allclose(L.padded(y, 41), [np.median(wide[i : i + 41]) for i in range(200)])
    with pytest.raises(ValueError):
        L.padded(y, 40)
    y[77] = 500
    found, odd = L.hampel(y, 20)
    assert odd[77] and found[77] == np.median(y[57:98]) and np.isnan(L.hampel(y, 20, to_null=True)[0][77])


def test_tables_of_long_and_short_frames(spark):
    data = {g: series(250, k, ties=False) for k, g in enumerate(("a", "b", None))}
    rows = [(g, k, float(k), None if np.isnan(v) else float(v), "kept") for g, y in data.items() for k, v in enumerate(y)]
    df = spark.createDataFrame(rows, "g string, t_idx int, t double, y double, more string").repartition(5)
    for w in (5, 61):
        cases = (
            (S.centred_median(df, ["g"], w), -(w // 2), w // 2),
            (S.causal_median(df, ["g"], w), -(w - 1), 0),
            (S.kotliar_median(df, ["g"], 1.0, w), w // 2, w // 2 + w - 1),
        )
        for k, (got, first, last) in enumerate(cases):
            assert got.columns == df.columns
            found = {(r["g"], r["t_idx"]): r["y"] for r in got.collect()}
            for g, y in data.items():
                want = plain(y, first, last)[0]
                if k == 2:
                    want[len(y) - w // 2 :] = np.nan
                mine = np.array([np.nan if found[g, i] is None else found[g, i] for i in range(250)])
                np.testing.assert_allclose(mine, want, rtol=1e-9)
    spiky = df.withColumn("y", F.when(F.col("t_idx") == 100, 900.0).otherwise(F.col("y")))
    for k in (4, 25):
        out = S.hampel(spiky, ["g"], k)
        assert {r["t_idx"] for r in out.where("outlier and y < 200").collect()} >= {100} and out.where("y > 200").isEmpty()
        assert S.hampel(spiky, ["g"], k, to_null=True).where("t_idx = 100 and y is null and outlier").count() == 3
    padded = S.padded_median(df.where("g = 'a'").fillna(100.0, ["y"]), ["g"], 61).orderBy("t_idx").toPandas()["y"].to_numpy()
    np.testing.assert_allclose(padded, L.padded(np.nan_to_num(data["a"], nan=100.0), 61))


def test_eight_series_of_8000_samples_and_101_frames_are_quick():
    ys = [series(8000, k, ties=False) for k in range(8)]
    took = min(_timed(ys) for _ in range(3))
    assert took < 0.6  # 0.2 s on an idle machine


def _timed(ys):
    began = time.perf_counter()
    for y in ys:
        L.frames(y, -50, 50)
    return time.perf_counter() - began
