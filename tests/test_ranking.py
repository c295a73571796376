"""Places, medians, intervals and signed ranks against plain sorts, with ties, NULL keys and a group of most rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwave.operators import kernels as K
from maskwave.operators import metrics as M
from maskwave.operators import ranking as R


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", float(v)) for v in np.round(rng.normal(0.2, 1, 6000), 1)] + [(None, float(v)) for v in rng.normal(0, 1, 301)]
    rows += [("few", 1.0), ("few", -1.0), ("one", 5.0), ("zeros", 0.0), ("zeros", 0.0), ("gone", None), ("even", 1.0), ("even", 2.0), ("even", 4.0), ("even", 9.0)]
    return spark.createDataFrame(rows, "g string, v double").repartition(7)


@pytest.fixture(scope="module")
def values(table):
    out = {}
    for g, v in table.collect():
        out.setdefault(g, []).append(v)
    return {g: np.sort(np.array([v for v in vs if v is not None])) for g, vs in out.items()}


def test_places_are_those_of_a_sort(table, values):
    got = R.places(table, ["g"], "v", {"twice": F.sum(F.col("v") * 2)}).collect()
    for g, vs in values.items():
        mine = {r["v"]: (r["low"], r["high"], r["n"], r["twice"]) for r in got if r["g"] == g}
        want = {float(v): (int(np.searchsorted(vs, v)) + 1, int(np.searchsorted(vs, v, "right")), int((vs == v).sum()), pytest.approx(2 * v * (vs == v).sum())) for v in np.unique(vs)}
        assert mine == want


def test_lookups_give_the_sorted_value(table, values):
    found = R.places(table, ["g"], "v")
    wanted = found.groupBy("g").agg(F.max("high").alias("size")).withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), "size")))
    got = {(r["g"], r["place"]): r["v"] for r in R.looked_up(found, wanted, ["g"], "v").collect()}
    assert got == {(g, k + 1): float(v) for g, vs in values.items() for k, v in enumerate(vs)}


def test_signed_ranks_are_those_of_the_kernel(table, values):
    got = {r["g"]: r for r in R.signed_ranks(table, ["g"], "v").withColumn("p", R.signed_rank_p("n_all", "n", "w_plus", "ties")).collect()}
    assert set(got) == {g for g, vs in values.items() if len(vs)}
    for g, r in got.items():
        d = values[g]
        p = K.wilcoxon(d)
        assert r["p"] is None if np.isnan(p) else r["p"] == pytest.approx(p, rel=1e-9)
        n = int((d != 0).sum())
        assert (r["n_all"], r["n"]) == (len(d), n) and r["w_plus"] + r["w_minus"] == n * (n + 1) / 2


def test_intervals_are_those_of_plain_resampling(table, values):
    got = {r["g"]: r for r in R.median_interval(table, ["g"], "v", 4000, 3).collect()}
    rng = np.random.default_rng(1)
    for g, vs in values.items():
        if not len(vs):
            assert g not in got
            continue
        boot = np.median(vs[rng.integers(0, len(vs), (4000, len(vs)))], axis=1)
        assert got[g]["median"] == pytest.approx(np.median(vs)) and got[g]["size"] == len(vs)
        spread = 0.15 * boot.std() + 1e-9
        for k, q in (("ci_low", 2.5), ("ci_high", 97.5)):
            near = np.percentile(boot, [max(q - 1, 0), min(q + 1, 100)])
            assert near[0] - spread <= got[g][k] <= near[1] + spread, (g, k)
    again = {r["g"]: tuple(r) for r in R.median_interval(table.repartition(3), ["g"], "v", 4000, 3).collect()}
    assert again == {g: tuple(r) for g, r in got.items()}


def test_cluster_statistics_gate_small_groups_and_keep_null_keys(table):
    rows = {r["g"]: r for r in M.cluster_stats(table.withColumnRenamed("v", "d").withColumn("n", F.lit(2).cast("long")), ["g"], 500).collect()}
    assert rows["few"]["median"] is None and rows["few"]["p"] is None and rows["few"]["n_clusters"] == 2
    assert rows[None]["n_clusters"] == 301 and rows[None]["n_samples"] == 602 and rows[None]["ci_low"] < rows[None]["median"] < rows[None]["ci_high"]
    assert rows["even"]["median"] == 3.0 and rows["gone"]["n_clusters"] == 0 and rows["hot"]["p"] < 1e-6


def test_a_million_pairs_of_one_group(spark):
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.randn(5) + 0.01).alias("d"), F.lit(1).cast("long").alias("n"))
    began = time.perf_counter()
    r = M.cluster_stats(df, ["g"]).first()
    took = time.perf_counter() - began
    assert r["n_clusters"] == 1_000_000 and r["ci_low"] < r["median"] < r["ci_high"] and r["ci_high"] - r["ci_low"] == pytest.approx(4 * 1.2533e-3, rel=0.1)
    assert took < 120
