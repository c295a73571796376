"""What plots are drawn from, and the comparisons of a study, against plain arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwave.functions.protocol import standard
from maskwave.operators import comparisons as C
from maskwave.operators import plotdata as D
from maskwave.plans.report_queries import _study

P = standard(1.0)
KEY = ["subject_id", "visit_id", "segment_label"]


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(100, 5, (320, 4)), 1)
    m = rng.random((320, 4)) > 0.2
    m[40:60] = False
    rows = [("1", None, "A1", "artery", k, float(k), j, float(x[k, j]) if m[k, j] else None, bool(m[k, j])) for k in range(320) for j in range(4)]
    rows += [("2", "0", "V3", "vein", k, float(k), 0, None, False) for k in range(320)]
    return spark.createDataFrame(rows, "subject_id string, visit_id string, segment_label string, vessel_type string, t_idx int, t double, locus int, x double, m boolean")


def test_lines_keep_the_extremes_of_every_pixel(spark):
    rng = np.random.default_rng(1)
    y = np.round(rng.normal(0, 1, 1000), 1)
    y[300:400] = np.nan
    df = spark.createDataFrame([("a", k / 10, None if np.isnan(v) else float(v)) for k, v in enumerate(y)], "g string, t double, y double").repartition(3)
    got = {}
    for r in D.line(df, ["g"], 10.0, 90.0, 16).collect():
        got.setdefault(r["pixel"], []).append((r["t"], r["y"]))
    t = np.arange(1000) / 10
    for p in range(16):
        at = (t >= 10 + 5 * p) & (t < 15 + 5 * p) & np.isfinite(y)
        if not at.any():
            assert p not in got
            continue
        points = sorted(got[p])
        assert 1 <= len(points) <= 4 and points[0][0] == t[at][0] and points[-1][0] == t[at][-1]
        assert min(v for _, v in points) == y[at].min() and max(v for _, v in points) == y[at].max()
    assert max(got) == 15
    with pytest.raises(ValueError):
        D.line(df, ["g"], 5.0, 5.0, 3)


def test_surfaces_show_gaps_and_ranges(cells):
    rows = D.surface(cells, 0.0, 320.0, 32).collect()
    assert len(rows) == 32 * 5
    gap = [r for r in rows if r["subject_id"] == "1" and r["pixel"] in (4, 5)]
    assert all(r["n"] == 0 and r["low"] is None for r in gap) and len(gap) == 8
    seen = np.array([r[0] for r in cells.where("m").select("x").collect()])
    a, b = np.percentile(seen, [1, 99])
    assert {(round(r["range_low"], 6), round(r["range_high"], 6)) for r in rows if r["subject_id"] == "1"} == {(round(a - 0.05 * (b - a), 6), round(b + 0.05 * (b - a), 6))}
    assert {r["range_low"] for r in rows if r["subject_id"] == "2"} == {None} and {r["row"] for r in rows} == {1, 2, 3, 4}


def test_triage_has_both_series(cells):
    got = D.triage(cells, P, 9.0, pixels=64)
    assert {r[0] for r in got.select("series").distinct().collect()} == {"raw", "smooth"} and got.where("subject_id = '2'").isEmpty()
    raw = D.triage(cells, P, 1.0, pixels=5000)
    assert raw.where("series = 'raw'").drop("series").exceptAll(raw.where("series = 'smooth'").drop("series")).isEmpty()
    assert D.shading(P)[:2] == [(0.0, 20.0, "global_baseline"), (20, 50, "baseline")] and len(D.shading(P)) == 10


def test_families_hold_their_members_and_one_is_adjusted(spark):
    out = {tuple(r[k] for k in C.BY): r for r in C.compared(_study(spark, "/root/testdata/sf0.01"), "cluster", 300).collect()}
    assert {k[0] for k in out} <= {f"rpca vs {m} ({c})" for m in ("sms_avg", "sms") for c in ("stationary", "non_stationary")} | {"sms_avg stationary vs non-stationary", "sms_avg stationary vs non-stationary (|bias|)"} and len({k[0] for k in out}) >= 3
    family = {k: r for k, r in out.items() if r["primary"] and r["p"] is not None}
    assert all(r["p_holm"] is None for k, r in out.items() if k not in family)
    ordered = sorted(family.values(), key=lambda r: r["p"])
    worst = 0.0
    for rank, r in enumerate(ordered):
        worst = max(worst, (len(ordered) - rank) * r["p"])
        assert r["p_holm"] == pytest.approx(min(worst, 1.0))


def test_measures_and_pairs(spark):
    rows = [(c, "artery", s, k, m, float(s + v), None, 1.0 + v, -2.0) for c in ("stationary", "non_stationary") for s in range(4) for k in range(2) for m, v in (("rpca", 3.0), ("sms", 1.0), ("sms_avg", 2.0 + (c == "stationary")))]
    df = spark.createDataFrame(rows, "condition string, vessel_type string, cluster int, config int, method string, sdr double, nmse double, bias_MD_c0 double, bias_tMAD_c2 double")
    values = C.measures(df, ["condition", "vessel_type", "cluster", "config", "method"])
    assert {(r["metric"], r["cycle"]) for r in values.select("metric", "cycle").distinct().collect()} == {("SDR", -1), ("bias_MD", 0), ("abs_bias_MD", 0), ("bias_tMAD", 2)}
    d = {(r["comparison"], r["metric"], r["cluster"]): (r["d"], r["n"]) for r in C.differences(values, "cluster").collect()}
    assert d["rpca vs sms (stationary)", "SDR", 1] == (2.0, 2) and d["rpca vs sms_avg (stationary)", "SDR", 0] == (0.0, 2) and d["rpca vs sms_avg (non_stationary)", "bias_MD", 3] == (1.0, 2)
    assert d["sms_avg stationary vs non-stationary", "bias_MD", 2] == (1.0, 2) and ("sms_avg stationary vs non-stationary", "SDR", 2) not in d
    assert ("sms_avg stationary vs non-stationary (|bias|)", "abs_bias_MD", 2) in d
    stats = C.compared(values, "cluster", 200).where("comparison = 'rpca vs sms (stationary)' and metric = 'bias_tMAD'").first()
    assert stats["n_clusters"] == 4 and stats["n_samples"] == 8 and stats["median"] == 0 and stats["p"] is None and not stats["primary"]
    assert C.amplitude_summary(values).where(F.col("metric") == "bias_MD").count() == 6
