"""Files in parts: the parser's cells are those of whole files, and no step holds a file."""

import random

import pytest
from pyspark.sql import functions as F

from maskwave.functions.protocol import Protocol
from maskwave.plans.catalog import QUERIES
from maskwave.sources import reader as R

P, FILES = Protocol("p", 25.0), "path string, content string"
HEAD = ["Diameters complete", "name", "-> position"]


def lines_of(seed):
    """Rows of a file: some with a time column, with cells that are missing, rows that are too wide and lines between that hold nothing."""
    rng, timed = random.Random(seed), seed % 2 == 0
    rows = [[f"{k / 25:.2f}" if timed else f"{rng.gauss(0, 9):.2f}", f"{rng.gauss(100, 9):.2f}".replace(".", ","), rng.choice(["1", "", "n.a."])] for k in range(40)]
    rows = [r + rng.choice([[]] * 6 + [["7"], ["x"]]) for r in rows]
    return [*HEAD, *[rng.choice(["\t".join(r)] * 9 + ["\t\t"]) for r in rows], "end"]


def cells(df, **settings):
    return sorted(map(repr, map(tuple, R.parse(df, P, settings=R.Settings(**settings)).collect())))


@pytest.mark.parametrize("skip", [0, 6])
def test_parts_of_files_are_read_as_the_files(spark, monkeypatch, skip):
    whole = [(f"/x/s{k}_0_A1.txt", lines_of(k)) for k in range(6)]
    want = cells(spark.createDataFrame([(p, "\n".join(v)) for p, v in whole], FILES), skip_lines=skip)
    assert len({w.split(",")[0] for w in want}) == 6
    parts = [(p, k, "\n".join(v[k : k + 7])) for p, v in whole for k in range(0, len(v), 7)]
    assert cells(spark.createDataFrame(parts[::-1], "path string, part int, content string"), skip_lines=skip) == want
    monkeypatch.setattr(R, "PART", 5)
    assert cells(spark.createDataFrame([(p, "\n".join(v)) for p, v in whole], FILES), skip_lines=skip) == want


def test_a_time_column_and_places_go_on_over_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "PART", 3)
    text = "\n".join(f"{k / 25:.2f}\t{k}" if k != 7 else "1\t2\t3" for k in range(20))
    rows = R.parse(spark.createDataFrame([("/x/s1_0_V3.txt", text), ("/x/s2_0_V3.txt", "1\t2")], FILES), P).orderBy("t_idx").collect()
    assert [(r["t_idx"], r["locus"], r["x"], r["dropped"]) for r in rows] == [(i, 0, float(k), 1) for i, k in enumerate(k for k in range(20) if k != 7)]


@pytest.mark.parametrize("name", ["reader_cells", "export_line_branches"])
def test_no_task_holds_the_rows_of_files(spark, name):
    """Rows and cells are made after the last shuffle; windows ran over all of them before."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    made = plan.index("Generate posexplode")
    assert "Window" not in plan and "Exchange" not in plan[:made]


def test_built_files_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "SPAN", 10)
    rows = spark.range(95).select(F.col("id").alias("o"))
    files = R.built(rows, F.concat(F.lit("/x/s"), (F.col("o") % 2).cast("string"), F.lit("_0_A1.txt")), "o", F.col("o").cast("string"), "head\n-> position")
    assert files.count() == 2 * (1 + 10) and files.agg(F.max(F.size(F.split("content", "\n")))).first()[0] == 5
    got = R.parse(files, P).orderBy("subject_id", "t_idx").select("subject_id", "t_idx", "x").collect()
    assert [tuple(r) for r in got] == [(f"s{k}", i, float(v)) for k in (0, 1) for i, v in enumerate(range(k, 95, 2))]
