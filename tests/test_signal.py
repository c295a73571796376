"""Operators on small made-up recordings: exact values, edges, properties."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwave.functions.missing import statistic, to_percent
from maskwave.functions.protocol import Cycle, Protocol, Window, standard
from maskwave.operators import aggregates as A
from maskwave.operators import biomarkers as B
from maskwave.operators import denoise as N
from maskwave.operators import hybrid as H
from maskwave.operators import metrics as M
from maskwave.operators import sequences as S
from maskwave.operators import smoothing as D
from maskwave.sources import reader as R
from maskwave.sources import sinks
from maskwave.streaming import gaps

P1 = standard(fs=1.0)


def trace(spark, values, method="m", label="A1"):
    rows = [("1", "0", label, "artery" if label[0] == "A" else "vein", method, i, float(i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "subject_id string, visit_id string, segment_label string, vessel_type string, method string, t_idx int, t double, y double")


def cells_of(spark, x):
    rows = [("1", "0", "A1", "artery", i, float(i), p, None if v is None else float(v), v is not None) for i, row in enumerate(x) for p, v in enumerate(row)]
    return spark.createDataFrame(rows, "subject_id string, visit_id string, segment_label string, vessel_type string, t_idx int, t double, locus int, x double, m boolean")


def step():
    return [105 if 50 <= t % 100 < 70 and t >= 50 and t < 320 else 97 if 70 <= t < 120 or 170 <= t < 220 or 270 <= t < 320 else 100 for t in range(320)]


def test_step_trace_has_its_levels(spark):
    rows = B.biomarkers(trace(spark, step()), P1).orderBy("cycle_index").collect()
    assert [r["cycle_index"] for r in rows] == [0, 1, 2]
    for r in rows:
        assert (r["dil_max"], r["con_max"], r["da"], r["bd"], r["dil_max_bc"], r["con_max_bc"]) == (105, 97, 8, 100, 5, -3)
        assert r["dil_max_t"] == 0 and r["auc"] == 105 * 19 and r["auc_dilation"] == 95 and r["auc_constriction"] == 3 * 49


def test_missing_window_fails_and_missing_values_do_not(spark):
    gone = [None if 150 <= t < 180 else v for t, v in enumerate(step())]
    rows = {r["cycle_index"]: r for r in B.extract(trace(spark, gone).where("t < 220"), P1).collect()}
    assert rows[0]["ok"] and rows[1]["ok"] and rows[1]["max_dilation"] is None
    assert not rows[2]["ok"] and rows[2]["error_stage"] == "compute:max_dilation"
    assert B.extract(trace(spark, gone).where("t < 220"), P1, keep_failed=False).count() == 2


def test_windows_are_half_open():
    w = Window("flicker", 1.0, 2.5)
    assert w.frames(1.0) == (1, 2) and w.frames(2.0) == (2, 5)
    assert P1.end() == 320 and len(P1.windows()) == 10 and [w.start for w in P1.phase("flicker")] == [50, 150, 250]
    P1.check()
    with pytest.raises(ValueError):
        Protocol("x", 1.0, None, (Cycle(0, None, Window("flicker", 0, 10), Window("recovery", 10, 60)),)).check()
    with pytest.raises(ValueError):
        Protocol("x", 1.0).reference()


def test_percent_and_statistics(spark):
    row = spark.range(1).select(to_percent(F.lit(110.0), F.lit(100.0)).alias("a"), to_percent(F.lit(1.0), F.lit(0.0)).alias("b"), to_percent(F.lit(50.0), F.lit(100.0), "ratio").alias("c")).first()
    assert (round(row["a"], 9), row["b"], row["c"]) == (10, None, 50)
    with pytest.raises(ValueError):
        statistic(F.col("x"), "mode")
    with pytest.raises(ValueError):
        A.min_valid(1.5, 1, F.lit(3))


def test_aggregates_skip_unobserved(spark):
    c = cells_of(spark, [[1, 2, 9], [None, 4, 6], [None, None, None]])
    got = [r["y"] for r in A.aggregate_loci(c).orderBy("t_idx").collect()]
    assert got == [2, 5, None]
    assert [r["supported"] for r in A.support(c, frac=0.6).orderBy("t_idx").collect()] == [True, True, False]


def test_interpolation_ends_and_gaps(spark):
    t = trace(spark, [None, 1, None, 3, None, None, None, 7, None])
    y = lambda df: [r["y"] for r in df.orderBy("t_idx").collect()]
    assert y(S.interpolate(t, ["segment_label"])) == [1, 1, 2, 3, 4, 5, 6, 7, 7]
    assert y(S.interpolate(t, ["segment_label"], ends="null")) == [None, 1, 2, 3, 4, 5, 6, 7, None]
    assert y(S.interpolate(t, ["segment_label"], max_gap=2)) == [None, 1, 2, 3, None, None, None, 7, None]
    assert y(S.interpolate(trace(spark, [None, 1, None]), ["segment_label"])) == [None, 1, None]


def test_hampel_replaces_a_spike(spark):
    v = [1.0 + 0.01 * (k % 3) for k in range(50)]
    v[25] = 100
    r = S.hampel(trace(spark, v), ["segment_label"]).where("outlier").collect()
    assert [x["t_idx"] for x in r] == [25] and r[0]["y"] < 2


def test_runs_and_empty_tables(spark):
    t = trace(spark, [1, None, None, 1, None, None, 1])
    assert [(r["start"], r["end"]) for r in S.runs(t, F.col("y").isNull(), ["segment_label"]).orderBy("start").collect()] == [(1, 2), (4, 5)]
    assert S.longest_run(t, F.col("y").isNull(), ["segment_label"]).first()["start"] == 1
    none = t.limit(0)
    assert B.extract(none, P1).count() == 0 and D.sms(none, P1).count() == 0 and D.kotliar_template(none, P1).count() == 0


def test_polynomial_matches_polyfit(spark):
    t = np.arange(330)
    y = 100 + 3 * np.sin(t / 40) + 0.01 * t
    got = np.array([r["y"] for r in D.polynomial(trace(spark, y), P1).orderBy("t_idx").collect()])
    pct = 100 * (y / np.median(y[:20]) - 1)
    want = np.polyval(np.polyfit(t, pct, 4), t)
    assert np.allclose(got, want, atol=1e-8)
    part = {r["t_idx"]: r["y"] for r in D.polynomial(trace(spark, y), P1, per_cycle=True).collect()}
    assert part[5] is None and part[60] is not None


def test_metrics_laws(spark):
    t = trace(spark, [3.0, -1, 2, 5]).select("segment_label", F.col("y").alias("truth"), F.col("y").alias("found"), (F.col("y") + 1).alias("corrupt"))
    r = M.fidelity(t, ["segment_label"]).first()
    assert r["sdr"] == 60 and r["nmse"] == 0 and r["delta_sdr"] > 0
    s = trace(spark, step())
    b = M.bias(s, s.withColumn("y", F.when(F.col("t") >= 50, F.col("y") + 1).otherwise(F.col("y"))), P1)
    assert b.where("biomarker = 'MD' and cycle_index = 0").first()["bias"] == 1
    assert M.bias(trace(spark, step(), label="V3"), trace(spark, step(), label="V3"), P1).where("biomarker in ('MC', 'DA')").count() == 0
    assert M.plateau_instability(M.bias(s, s, P1), ["segment_label"]).first()["instability"] == 0


def test_cluster_statistics(spark):
    m = spark.createDataFrame([(0, k, float(k + 1), 2) for k in range(12)], "g int, c int, d double, n long")
    r = M.cluster_stats(m, ["g"], resamples=500).first()
    assert r["median"] == 6.5 and r["ci_low"] < 6.5 < r["ci_high"] and np.isclose(r["p"], 2 / 2**12)


def test_rpca_trace_recovers_a_response(spark):
    rng = np.random.default_rng(0)
    base = np.array(step(), float)
    x = base[:, None] + rng.normal(0, 0.5, (320, 12))
    x[100:110, 3] = np.nan
    c = cells_of(spark, [[None if np.isnan(v) else v for v in row] for row in x])
    got = {r["t_idx"]: r["y"] for r in N.rpca_trace(c, P1, N.RpcaConfig(lam=3.0, gamma=0.0, hampel=False)).collect()}
    assert len(got) == 320 and abs(got[60] - 5) < 1 and abs(got[100] + 3) < 1
    parts = N.decompose(c, P1, N.RpcaConfig(standardize=False, max_iter=5)).where("not m").agg(F.max(F.abs("a"))).first()[0]
    assert parts == 0


def test_group_rpca_numbers_loci_through(spark):
    a = cells_of(spark, [[1, 2]] * 5)
    both = a.unionByName(a.withColumn("segment_label", F.lit("A2")))
    assert sorted(r["joint_locus"] for r in N.joint(both).where("t_idx = 0").collect()) == [0, 1, 2, 3]


def test_hybrids_repeat_and_hold_their_truth(spark):
    rng = np.random.default_rng(1)
    c = cells_of(spark, (100 + rng.normal(0, 0.2, (320, 3))).tolist())
    one = H.build(c, P1, n_configs=2, jitter=0).orderBy("config", "t_idx", "locus").collect()
    again = H.build(c.repartition(7), P1, n_configs=2, jitter=0).orderBy("config", "t_idx", "locus").collect()
    assert one == again and len(one) == 2 * 320 * 3
    peak = max(r["truth"] for r in one if r["truth"] is not None)
    assert 1 < peak < 12
    seen = [abs(r["x"] - 100 * (1 + r["truth"] / 100)) for r in one if r["m"]]
    assert np.median(seen) < 0.5


def test_reader(spark):
    text = "Diameters complete\nname\n\n-> position\n" + "\n".join(f"{k / 25:.2f}\t1,5\t{k}\tabc" for k in range(20)) + "\n9\t9\t9\t9\t9\n"
    rtf = r"{\rtf1 x\par 1.0\tab 2.0\par 3.0\tab 4.0\par}"
    files = spark.createDataFrame([("/d/001_0_A1.txt", text), ("/d/002_1_V3.rtf", rtf), ("/d/random_file.txt", "1\t2"), ("/d/003_0_A1.txt", "")], "path string, content string")
    rows = R.parse(files, P1).orderBy("subject_id", "t_idx", "locus").collect()
    first = [r for r in rows if r["subject_id"] == "001"]
    assert len(first) == 60 and first[0]["x"] == 1.5 and first[1]["x"] == 0 and first[2]["x"] is None and first[0]["dropped"] == 1
    second = [r for r in rows if r["subject_id"] == "002"]
    assert [r["x"] for r in second] == [1, 2, 3, 4] and second[0]["vessel_type"] == "vein"
    assert {r["subject_id"] for r in rows} == {"001", "002"}


def test_numbers(spark):
    got = spark.createDataFrame([("3.14",), ("3,14",), ("",), ("abc",), ("1.2.3",), (" 7 mm",)], "v string").select(R.number(F.col("v"))).collect()
    assert [r[0] for r in got] == [3.14, 3.14, None, None, None, 7.0]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "7_0_A2.csv").write_text("1\t2\n3\t4\n5\t6\n")
    c = R.read(spark, str(tmp_path / "in"), P1)
    assert c.count() == 6 and c.first()["segment_label"] == "A2"
    sinks.write_parquet(c.withColumn("method", F.lit("raw")), str(tmp_path / "p"))
    sinks.write_csv(c.withColumn("a", F.array(F.lit(1))), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 6 and spark.read.option("header", True).csv(str(tmp_path / "c")).first()["a"] == "[1]"


def test_inclusion_lists(spark):
    lists = R.inclusion_list(spark.createDataFrame([(json.dumps({"A1": ["1"], "_note": ["x"]}),), (None,)], "content string"))
    t = trace(spark, [1, 2])
    assert lists.count() == 1 and R.keep_included(t, lists).count() == 2 and R.keep_included(t, None).count() == 2
    assert R.keep_included(t, lists.limit(0)).count() == 0


def test_streaming_reports(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:10:00", "a", None), ("2024-01-01 02:00:00", "a", 2.0)], "t string, segment string, value double").select(F.col("t").cast("timestamp").alias("ts"), "segment", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = gaps.windowed_missing(stream).writeStream.format("memory").queryName("missing").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["n_valid"]) for r in spark.sql("select * from missing").collect()) == [(1, 1), (2, 1)]
    assert gaps.sessions(rows).count() == 2
