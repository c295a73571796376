"""Preprocessors by name, runs from a folder, evaluations, sweeps and comparisons."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from maskwave.functions.protocol import standard
from maskwave.operators import denoise as N
from maskwave.operators import evaluation as E
from maskwave.operators import hybrid as H
from maskwave.operators import kernels as K
from maskwave.operators import metrics as M
from maskwave.sources import reader, results, sinks

P = standard(fs=2.0)


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(1)
    t = np.arange(640) / 2
    rows = []
    for subject in ("1", "2"):
        for label, kind in (("A1", "artery"), ("V3", "vein")):
            x = 100 + rng.normal(0, 0.6, (640, 6)) + np.sin(t)[:, None]
            m = rng.random((640, 6)) > 0.05
            rows += [(subject, "0", label, kind, k, float(t[k]), j, float(x[k, j]) if m[k, j] else None, bool(m[k, j])) for k in range(640) for j in range(6)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["subject_id", "visit_id", "segment_label", "vessel_type", "t_idx", "t", "locus", "x", "m"]), "subject_id string, visit_id string, segment_label string, vessel_type string, t_idx int, t double, locus int, x double, m boolean").withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def test_preprocessors_by_name(spark, cells):
    with pytest.raises(ValueError):
        E.preprocess(cells, P, "no such one")
    with pytest.raises(ValueError):
        E.run(spark, "/tmp", None)
    E.register("flat", lambda c, protocol: c.groupBy("subject_id", "visit_id", "segment_label", "vessel_type", "t_idx", "t").agg(F.lit(1.0).alias("y")))
    table = E.parameters(cells, P, ("flat", "kotliar"))
    assert {r["method"]: r["n"] for r in table.groupBy("method").agg(F.count("*").alias("n")).collect()} == {"flat": 12, "kotliar": 12}
    seen = E.as_cells(E.preprocess(cells, P, "raw"))
    assert seen.where("m").count() > 2000 and seen.where("locus <> 0").count() == 0


def test_run_from_a_folder(spark, tmp_path):
    rng = np.random.default_rng(3)
    for name in ("S1_0_A1", "S2_0_V3"):
        body = "\n".join("\t".join(f"{v:.3f}" for v in row) for row in 100 + rng.normal(0, 1, (640, 5)))
        (tmp_path / f"{name}.txt").write_text("a note\n" + body + "\n")
    out = E.run(spark, str(tmp_path), P, "kotliar", settings=reader.Settings(skip_lines=1, expected_samples=640, strict=True))
    assert out["cells"].count() == 2 * 640 * 5
    with pytest.raises(PySparkException):
        reader.read(spark, str(tmp_path), P, settings=reader.Settings(skip_lines=1, expected_samples=600, strict=True)).count()
    sinks.write_parquet(out["parameters"], f"{tmp_path}/table")
    one = results.read_parameters(spark, f"{tmp_path}/table")
    assert one.where("ok").count() == 6
    with pytest.raises(ValueError):
        results.read_traces(spark, f"{tmp_path}/table")
    sinks.write_csv(one.select("subject_id", "cycle_index", "max_dilation"), f"{tmp_path}/flat")
    assert results.read_csv(spark, f"{tmp_path}/flat", "subject_id string, cycle_index int, max_dilation double").where("max_dilation is not null").count() == 6


def test_evaluation_has_every_method(cells):
    config = N.RpcaConfig(max_iter=20)
    got = E.evaluate(H.build(cells.where("subject_id = '1'"), P, 1), P, config=config).toPandas()
    assert sorted(got["method"].unique()) == sorted(E.METHODS) and len(got) == 2 * 5
    assert got["sdr"].notna().all() and got["delta_sdr"].notna().all() and (got["nmse"] > 0).all()
    assert got.loc[got["segment_label"] == "V3", "bias_MC_c0"].isna().all() and got.loc[got["segment_label"] == "A1", "bias_MC_c0"].notna().any()
    dep = H.build(cells, P, 40).where("segment_label = 'A1'").groupBy("subject_id", "config").agg(F.max("truth").alias("top"), F.min("truth").alias("low")).toPandas()
    assert dep["top"].max() < 9 and np.corrcoef(dep["top"], dep["low"])[0, 1] > 0.3  # strong dilators constrict little


def test_sweeps_have_the_same_draws(cells):
    hybrid = H.build(cells, P, 1, sweep=("attenuation", (1.0, 0.0)))
    last = hybrid.where("segment_label = 'V3' and t >= 250 and t < 290").groupBy("subject_id", "level").agg(F.max("truth").alias("top")).toPandas()
    assert (last[last["level"] == 0]["top"].abs() < 1e-9).all() and (last[last["level"] == 1]["top"] > 0.5).all()
    first = hybrid.where("t < 200").groupBy("subject_id", "segment_label", "t_idx").agg((F.max("truth") - F.min("truth")).alias("d"))
    assert first.agg(F.max("d")).first()[0] < 1e-12
    drifted = E.evaluate(H.build(cells, P, 1, sweep=("drift", (0.0, 2.0))), P, ("sms",), by=("level",)).groupBy("level").agg(F.avg("sdr").alias("s")).toPandas().set_index("level")["s"]
    assert drifted[2.0] < drifted[0.0]
    with pytest.raises(ValueError):
        H.build(cells, P, 1, sweep=("other", (1.0,)))


def test_grid_levels_are_what_a_single_run_has(cells):
    hybrid = H.build(cells.where("subject_id = '1'"), P, 1)
    config = N.RpcaConfig(max_iter=10)
    grid = E.grid_search(hybrid, P, (0.3, 0.55), (100.0,), config).toPandas().set_index("lam")["mean_sdr"]
    alone = E.grid_search(hybrid, P, (0.3,), (100.0,), config).toPandas().set_index("lam")["mean_sdr"]
    assert np.isclose(grid[0.3], alone[0.3]) and len(grid) == 2


def test_triplets_scale_the_cycles(spark, cells):
    triplets = spark.createDataFrame([(1.0, 0.0, 2.0)], "m0 double, m1 double, m2 double")
    top = E.non_stationary(triplets, cells, P).where("segment_label = 'V3'")
    second = top.where("t >= 150 and t < 190").agg(F.max(F.abs("truth"))).first()[0]
    assert second < 1e-9 < top.where("t >= 250 and t < 290").agg(F.max("truth")).first()[0]


def test_paired_statistics_and_families(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{k}", m, float(k % 5 + shift + rng.normal(0, 0.1))) for k in range(12) for m, shift in (("a", 1.0), ("b", 0.0), ("c", 0.0))]
    table = spark.createDataFrame(rows, "subject_id string, method string, sdr double")
    got = M.compare_methods(table, "sdr", "subject_id", {"ab": ("a", "b", False), "bc": ("b", "c", False)}, ("ab", "bc"), ["subject_id"], 500).toPandas().set_index("family")
    assert abs(got.loc["ab", "median"] - 1) < 0.2 and got.loc["ab", "p_holm"] == pytest.approx(2 * got.loc["ab", "p"]) and got.loc["bc", "p"] > 0.05
    wide = spark.createDataFrame([("g", float(x), float(x) - d) for x, d in zip(range(9), (1, 2, 3, 4, 5, 6, 7, 8, 9), strict=True)] + [("few", 1.0, 2.0)], "g string, x double, y double")
    stats = M.paired_stats(wide, ["g"], "x", "y", resamples=200).toPandas().set_index("g")
    assert stats.loc["g", "median"] == 5 and stats.loc["g", "p"] == pytest.approx(2 / 512) and np.isnan(stats.loc["few", "median"])


def test_cardiac_band_holds_the_heartbeat(spark):
    fs, n = 25.0, 640
    t = np.arange(n) / fs
    beat = np.sin(2 * np.pi * 1.2 * t)
    x = 50 + beat[:, None] + np.array([0.0, 0.5])
    rows = [("1", "0", "A1", "artery", k, float(t[k]), j, float(x[k, j]), True) for k in range(n) for j in range(2)]
    frame = spark.createDataFrame(rows, "subject_id string, visit_id string, segment_label string, vessel_type string, t_idx int, t double, locus int, x double, m boolean")
    got = N.cardiac_band(frame, standard(fs)).toPandas().sort_values(["locus", "t_idx"])
    inner = got[(got["locus"] == 0) & got["t_idx"].between(150, 350)]
    assert np.abs(inner["cardiac"].to_numpy() - beat[150:351]).max() < 0.25 and got[got["t_idx"] >= 500]["noise"].isna().all()


def test_group_heartbeats_are_those_of_segments(spark):
    """Two segments that beat in opposite phase: their joint mean would show no heartbeat."""
    fs, n = 25.0, 900
    t = np.arange(n) / fs
    rows = []
    for label, sign in (("A1", 1.0), ("A2", -1.0)):
        x = 50 + 2 * sign * np.sin(2 * np.pi * 1.2 * t) + np.sin(2 * np.pi * 6.0 * t)
        rows += [("1", "0", label, "artery", k, float(t[k]), j, float(x[k]), True) for k in range(n) for j in range(2)]
    frame = spark.createDataFrame(rows, "subject_id string, visit_id string, segment_label string, vessel_type string, t_idx int, t double, locus int, x double, m boolean")
    run = lambda extra: N.group_rpca_trace(frame, standard(fs), lowpass_extra=extra, average=None, max_iter=5).where("segment_label = 'A1'").orderBy("t_idx").toPandas()["y"].to_numpy()
    fast = lambda y: np.abs(np.fft.rfft(y[100:800] - y[100:800].mean()))[int(6.0 * 700 / fs)]
    assert fast(run(0.5)) < 0.1 * fast(run(None))


def test_effective_rank_needs_no_rows_together(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 1)) @ rng.normal(size=(1, 6)) + 0.1 * rng.normal(size=(200, 6))
    rows = [("g", k, j, float(x[k, j]) if (k, j) != (3, 2) else None) for k in range(200) for j in range(6)]
    got = N.effective_rank(spark.createDataFrame(rows, "g string, r int, c int, v double").repartition(5), ["g"], "r", "c", "v").first()
    want = K.effective_rank(np.delete(x, 3, axis=0))
    assert np.isclose(got["pc1"], want["pc1"]) and got["n_samples"] == 199 and got["n_loci"] == 6


def test_ten_iterations_are_quick():
    import time

    rng = np.random.default_rng(5)
    x, m = rng.normal(size=(40, 8000)), rng.random((40, 8000)) > 0.05
    began = time.perf_counter()
    K.masked_rpca(x, m, gamma=1000.0, max_iter=10, tol=0.0)
    assert time.perf_counter() - began < 3


def test_artefacts_hit_all_loci_at_once_for_as_long_as_they_last(spark):
    a = H.Artefacts(impulse_rate=0.0, burst_rate=6.0, burst_sd=0.0, burst_jitter=0.0, positive=1.0)
    frames = spark.range(20000).select(F.col("id").cast("int").alias("t_idx"), F.explode(F.array(F.lit(0), F.lit(1))).alias("locus"))
    out = frames.withColumn("y", H.artefact(a, 7, 10.0, [F.lit("u")], F.col("t_idx"), F.col("locus"))).toPandas()
    one, two = (out[out.locus == k].sort_values("t_idx").y.to_numpy() for k in (0, 1))
    assert np.allclose(one, two) and np.allclose(one / 12, np.round(one / 12))
    on = np.flatnonzero(np.diff(np.r_[0, one != 0, 0]))
    lengths = on[1::2] - on[::2]
    assert 150 < len(lengths) < 250 and lengths[:-1].min() >= 3 and np.median(lengths) <= 15
    impulses = frames.withColumn("y", H.artefact(H.Artefacts(burst_rate=0.0, impulse_rate=60.0), 7, 10.0, [F.lit("u")], F.col("t_idx"), F.col("locus"))).toPandas()
    share = (impulses[impulses.locus == 0].y != 0).mean()
    assert 0.08 < share < 0.12 and 10 < impulses[impulses.y > 0].y.mean() < 20
    assert 0.5 < (impulses[impulses.y != 0].y > 0).mean() < 0.7


def test_simple_hybrids_hold_their_response_and_the_own_mask(spark, cells):
    flat = cells.withColumn("x", F.lit(100.0) + F.col("locus"))
    out = H.build_simple(flat, P).toPandas()
    held = out[out.m]
    assert len(out) == cells.count() and len(held) == cells.where("m").count()
    assert np.allclose(held.x, (100 + held.locus) * (1 + held.truth / 100))
    assert (out[out.t < 50].truth == 0).all() and out[(out.t >= 60) & (out.t < 70)].truth.min() > 0.2
    assert out.groupby(["subject_id", "segment_label", "t_idx"]).truth.nunique().max() == 1
