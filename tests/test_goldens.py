"""Comparison with kept results, and goldens of the kernels that no SQL can check, from dense solvers of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwave.functions.protocol import standard
from maskwave.operators import denoise as N
from maskwave.operators import kernels as K
from maskwave.sources import goldens as G

P = standard(1.0)
CELLS = "subject_id string, visit_id string, segment_label string, vessel_type string, t_idx int, t double, locus int, x double, m boolean"


def test_differences_by_tolerance(spark, tmp_path):
    schema = "k int, g string, v double, n long, s string"
    golden = spark.createDataFrame([(1, "a", 1.0, 5, "x"), (2, None, 2.0, 5, "x"), (3, "a", None, None, None), (4, "a", 100.0, 7, "y"), (5, "a", 1.0, 1, "z"), (6, "a", 1.0, 1, "z")], schema)
    found = spark.createDataFrame([(1, "a", 1.0 + 1e-12, 5, "x"), (2, None, 2.1, 5, "x"), (3, "a", float("nan"), None, None), (4, "a", 100.05, 8, "Y"), (5, "a", 1.0, 1, "z"), (5, "a", 1.0, 1, "z"), (7, "a", 1.0, 1, "z")], schema)
    rows = {(r["k"], r["column"]): (r["golden"], r["found"]) for r in G.differences(found, golden, ["k", "g"]).collect()}
    assert rows == {(2, "v"): ("2.0", "2.1"), (4, "v"): ("100.0", "100.05"), (4, "n"): ("7.0", "8.0"), (4, "s"): ("y", "Y"), (5, None): ("1", "2"), (6, None): ("1", None), (7, None): (None, "1")}
    loose = {(r["k"], r["column"]) for r in G.differences(found, golden, ["k", "g"], by_column={"v": 1e-3}, absolute=0.06).collect()}
    assert loose == {(2, "v"), (4, "n"), (4, "s"), (5, None), (6, None), (7, None)}
    with pytest.raises(ValueError):
        G.differences(found.drop("s"), golden, ["k", "g"])
    G.write(golden, f"{tmp_path}/g")
    G.check(spark, golden, f"{tmp_path}/g", ["k", "g"])
    with pytest.raises(AssertionError):
        G.check(spark, found, f"{tmp_path}/g", ["k", "g"])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        G.write(golden, f"{tmp_path}/g")


def dense_rpca(x, m, lam, mu, rho, gamma, steps):
    """The same iterations with a whole singular value decomposition and a dense system for every locus."""
    p, t = x.shape
    difference = np.diff(np.eye(t), axis=0)
    x = np.where(m, x, 0.0)
    s, a, z, y, u = (np.zeros((p, t)) for _ in range(5))
    for _ in range(steps):
        r = x - s + y
        a = np.where(m, np.sign(r) * np.maximum(np.abs(r) - lam / mu, 0), 0)
        left, values, right = np.linalg.svd(s + u, full_matrices=False)
        z = left @ np.diag(np.maximum(values - 1 / rho, 0)) @ right
        s = np.array([np.linalg.solve(np.diag(rho + mu * m[i]) + gamma * difference.T @ difference, (rho * (z - u) + mu * m * (x - a + y))[i]) for i in range(p)])
        y, u = y + np.where(m, x - s - a, 0), u + s - z
    return s, a


@pytest.mark.parametrize("gamma", [0.0, 1000.0])
def test_decomposition_against_dense_goldens(spark, tmp_path, gamma):
    rng = np.random.default_rng(5)
    rows, golden = [], []
    for k, label in enumerate(("A1", "A2", "V3")):
        x = np.outer(rng.normal(1, 0.2, 6), np.sin(np.arange(90) / 9)) * 5 + rng.normal(0, 0.3, (6, 90))
        x[rng.random(x.shape) < 0.03] += 12
        m = rng.random(x.shape) > 0.1
        s, a = dense_rpca(x, m, 0.55, 1.0, 5.0, gamma, 12)
        for i in range(6):
            for t in range(90):
                ids = (str(k), "0", label, "artery" if label[0] == "A" else "vein", t, float(t), i)
                rows.append((*ids, float(x[i, t]) if m[i, t] else None, bool(m[i, t])))
                golden.append((str(k), label, t, i, float(s[i, t]), float(a[i, t])))
    G.write(spark.createDataFrame(golden, "subject_id string, segment_label string, t_idx int, locus int, s double, a double"), f"{tmp_path}/rpca")
    cells = spark.createDataFrame(rows, CELLS)
    found = N.decompose(cells.repartition(5), P, N.RpcaConfig(gamma=gamma, standardize=False, max_iter=12, tol=0.0))
    G.check(spark, found.select("subject_id", "segment_label", "t_idx", "locus", "s", "a"), f"{tmp_path}/rpca", ["subject_id", "segment_label", "t_idx", "locus"], relative=1e-8, absolute=1e-9)


def test_heartbeats_against_sums_of_cosines(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows, golden, fs, n = [], [], 25.0, 256
    for k in range(3):
        y = np.sin(2 * np.pi * (0.8 + 0.3 * k) * np.arange(1000) / fs) + rng.normal(0, 0.2, 1000)
        rows += [(str(k), "0", "A1", "artery", t, t / fs, float(v)) for t, v in enumerate(y)]
        window = np.array([0.5 * (1 - np.cos(2 * np.pi * j / n)) for j in range(n)])
        power = np.zeros(n // 2 + 1)
        starts = range(0, 1000 - n + 1, n // 2)
        for at in starts:
            part = (y[at : at + n] - y[at : at + n].mean()) * window
            for f in range(n // 2 + 1):
                angle = 2 * np.pi * f * np.arange(n) / n
                power[f] += ((part @ np.cos(angle)) ** 2 + (part @ np.sin(angle)) ** 2) * (1 if f in (0, n // 2) else 2) / (fs * (window**2).sum()) / len(starts)
        hz = np.arange(n // 2 + 1) * fs / n
        inside = (hz >= 0.5) & (hz <= 2.0)
        best = int(np.flatnonzero(inside)[power[inside].argmax()])
        golden.append((str(k), float(60 * hz[best]), float(power[best])))
    G.write(spark.createDataFrame(golden, "subject_id string, bpm double, peak double"), f"{tmp_path}/beats")
    traces = spark.createDataFrame(rows, "subject_id string, visit_id string, segment_label string, vessel_type string, t_idx int, t double, y double")
    G.check(spark, N.heartbeats(traces, fs).select("subject_id", "bpm", "peak"), f"{tmp_path}/beats", ["subject_id"], relative=1e-9)


def test_effective_rank_against_a_whole_decomposition():
    x = np.random.default_rng(7).normal(size=(50, 6)) @ np.diag([5, 3, 1, 1, 0.5, 0.1])
    got = K.rank_of_sums(50, x.sum(axis=0), x.T @ x)
    values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert np.isclose(got["pc1"], values[0] / values.sum(), rtol=1e-9) and np.isclose(got["pc2"], values[1] / values.sum(), rtol=1e-9)


def test_a_golden_of_rows_in_any_order(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") / 7).alias("v"))
    G.write(df.orderBy(F.desc("id")), f"{tmp_path}/o")
    G.check(spark, df.repartition(9), f"{tmp_path}/o", ["id"])


def test_a_notch_takes_the_heartbeat_away(spark):
    fs, t = 25.0, np.arange(1500)
    slow, beat = np.sin(2 * np.pi * 0.05 * t / fs), np.sin(2 * np.pi * 1.2 * t / fs)
    rows = [("1", "0", "A1", int(k), float(slow[k] + beat[k])) for k in t] + [("2", "0", "A1", int(k), None if k == 7 else float(beat[k])) for k in t]
    out = N.notched_average(spark.createDataFrame(rows, "subject_id string, visit_id string, segment_label string, t_idx int, y double"), fs).toPandas().sort_values("t_idx")
    got = out[out["subject_id"] == "1"]["y"].to_numpy()
    assert np.abs(got - slow)[200:-200].max() < 0.15
    kept = out[out["subject_id"] == "2"]["y"].to_numpy()
    assert np.isnan(kept[7]) and np.allclose(np.delete(kept, 7), np.delete(beat, 7))
