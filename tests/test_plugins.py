"""A user's own parameters and preprocessors, and errors that stay with the segment where they arise."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwave.functions.protocol import standard
from maskwave.operators import aggregates as A
from maskwave.operators import biomarkers as B
from maskwave.operators import evaluation as E
from maskwave.operators import plugins as U
from maskwave.plans.catalog import QUERIES
from maskwave.sources import exports as X

P = standard(2.0)
CELLS = "subject_id string, visit_id string, segment_label string, vessel_type string, t_idx int, t double, locus int, x double, m boolean"


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(0)
    rows = []
    for subject, label in (("1", "A1"), ("1", "V3"), ("2", "A1"), ("3", "V3")):
        x = 100 + rng.normal(0, 1, (640, 14))
        rows += [(subject, "0", label, "artery" if label[0] == "A" else "vein", k, k / 2, j, float(x[k, j]), True) for k in range(640) for j in range(14) if not (subject == "2" and k == 5 and j == 3)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")]), CELLS)


def test_a_broken_segment_leaves_the_others_whole(cells):
    table = E.parameters(cells, P, ("rpca",)).toPandas()
    bad = table[table["subject_id"] == "2"]
    assert len(bad) == 3 and not bad["ok"].any() and set(bad["error_stage"]) == {"preprocess:rpca"} and bad["error"].str.startswith("ValueError: cannot reshape").all() and bad["max_dilation"].isna().all()
    alone = E.parameters(cells.where("subject_id <> '2'"), P, ("rpca",)).toPandas()
    by = ["subject_id", "segment_label", "cycle_index"]
    pd.testing.assert_frame_equal(table[table["subject_id"] != "2"].sort_values(by).reset_index(drop=True), alone.sort_values(by).reset_index(drop=True))
    assert alone["ok"].all() and E.parameters(cells, P, ("rpca",), keep_failed=False).count() == 9


def test_a_broken_recording_of_the_group_method(cells):
    traces = E.preprocess(cells, P, "group_rpca", max_iter=3)
    rows = traces.where("error is not null").collect()
    assert [(r["subject_id"], r["segment_label"], r["error_stage"], r["t_idx"], r["y"]) for r in rows] == [("2", "A1", "preprocess:group_rpca", None, None)]
    assert traces.where("error is null and y is not null").count() == 3 * 640


def test_a_users_function_agrees_with_the_declared_column(cells):
    traces = A.aggregate_loci(cells.where("t < 290 or subject_id <> '3'")).withColumn("method", F.lit("raw")).withColumn("y", F.when(F.col("t") != 55.0, F.col("y")))

    def top(y, t, cycle):
        at = (t >= cycle.flicker.start) & (t < cycle.flicker.end)
        y[:] = np.where(at, y, -1)  # its own copy
        return np.nanmax(y[at])

    def never(y, t, cycle):
        raise KeyError(cycle.index)

    mine = (B.computed("top", top), B.DEFAULT_SET[0], B.computed("inf", lambda y, t, cycle: np.inf), B.computed("after", lambda y, t, cycle: len(y) + t[0]))
    table = B.extract(traces, P, mine).toPandas()
    assert len(table) == 12 and table["ok"].all() and (table["top"] == table["max_dilation"]).all() and table["inf"].isna().all()
    assert set(table.loc[table["subject_id"] == "3", "after"]) == {580.0} and set(table.loc[table["subject_id"] == "1", "after"]) == {640.0}
    table = B.extract(traces.where("t < 250"), P, (B.DEFAULT_SET[0], B.computed("never", never))).toPandas().set_index("cycle_index")
    assert set(table.loc[0, "error"]) == {"KeyError: 0"} and set(table.loc[0, "error_stage"]) == {"compute:never"} and table.loc[0, "max_dilation"].notna().all()
    assert set(table.loc[2, "error_stage"]) == {"compute:max_dilation"}  # the first in order names the error


def test_preprocessors_of_segments_and_recordings(cells):
    E.register("mine", U.segments(lambda t, x, m, protocol, shift=0.0: np.where(m.any(axis=1), np.nanmean(x, axis=1), np.nan) + shift))
    got = E.preprocess(cells, P, "mine", shift=5.0)
    want = cells.groupBy("subject_id", "segment_label", "t_idx").agg((F.avg("x") + 5).alias("w"))
    both = got.join(want, ["subject_id", "segment_label", "t_idx"])
    assert both.count() == 4 * 640 and both.where("abs(y - w) > 1e-9 or error is not null").isEmpty()
    E.register("short", U.segments(lambda t, x, m, protocol: np.zeros(3)))
    assert {r["error"] for r in E.preprocess(cells, P, "short").collect()} == {"ValueError: a trace of shape (3,) for 640 times"}
    E.register("arteries", U.recordings(lambda segments, protocol: {k: np.nanmean(x, axis=1) for k, (t, x, m) in segments.items() if k[0] == "A"}))
    rows = E.preprocess(cells, P, "arteries")
    assert {(r["subject_id"], r["segment_label"], r["error"]) for r in rows.where("error is not null").collect()} == {("1", "V3", "KeyError: 'V3'"), ("3", "V3", "KeyError: 'V3'")}
    assert rows.where("y is not null").count() == 2 * 640


def test_files_that_cannot_be_read_are_rows_of_the_table(spark, tmp_path):
    rng = np.random.default_rng(1)
    for name in ("a_0_A1.txt", "b_0_V3.txt"):
        (tmp_path / name).write_text("\n".join("\t".join(f"{v:.3f}" for v in row) for row in 100 + rng.normal(0, 1, (640, 5))))
    (tmp_path / "c_0_A1.txt").write_text("no numbers at all")
    X.register(spark)
    cells = spark.read.format("maskwave").options(**X.options(P, mode="PERMISSIVE")).load(str(tmp_path))
    table = E.parameters(cells, P, ("kotliar",), B.DEFAULT_SET).collect()
    assert {(r["subject_id"], r["ok"], r["error"], r["error_stage"]) for r in table} == {("a", True, None, None), ("b", True, None, None), ("c", False, "ValueError: no rows of numbers", "read")} and len(table) == 9


@pytest.mark.parametrize("name", ["user_parameters", "segment_errors", "recording_preprocessor"])
def test_queries_hold_rows_of_both_kinds(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.01")
    assert rows.where("error is null").count() > 0
    if name != "recording_preprocessor":
        assert rows.where("error is not null").count() > 0
