"""The data source of exports: formats, modes, predicates, the writer, and agreement of its parser with the one of expressions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwave.functions.protocol import standard
from maskwave.operators import quality
from maskwave.sources import exports as X
from maskwave.sources import reader

HEAD = "Diameters complete\nname\nby\n1 -> position\n"


@pytest.fixture
def folder(spark, tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "deep").mkdir()
    for k in range(4):
        lines = ["\t".join(f"{v:.3f}" for v in row) for row in rng.normal(100, 2, (40, 3))]
        (tmp_path / "deep" / f"s{k}_0_A1.txt").write_text(HEAD + "\n".join(lines) + "\n")
    rich = "{\\rtf1}\\par h\\par h\\par h\\par " + "\\par ".join(f"{k},5\\tab {k + 1},25\\tab " for k in (3, 9, 4, 8)) + "\\par"
    (tmp_path / "s9_1_V3.rtf").write_text(rich)
    (tmp_path / "random_file.dat").write_text("1 2\n3 4\n")
    (tmp_path / "random.txt").write_text("1 2\n3 4\n")
    X.register(spark)
    return tmp_path


def read(spark, folder, name="maskwave", **more):
    return spark.read.format(name).options(fs="25", **more).load(str(folder))


def test_a_folder_is_read_through_the_format(spark, folder):
    df = read(spark, folder, units="um")
    assert df.schema.simpleString() == f"struct<{X.CELLS.replace(' ', ':').replace(',:', ',')}>"
    found = {(r["subject_id"], r["vessel_type"]): (r["n"], r["t"]) for r in df.groupBy("subject_id", "vessel_type").agg(F.count("*").alias("n"), F.max("t").alias("t")).collect()}
    assert found == {**{(f"s{k}", "artery"): (120, 39 / 25) for k in range(4)}, ("s9", "vein"): (12, 3 / 25)}
    rich = [tuple(r) for r in df.where("subject_id = 's9' and locus < 2").orderBy("t_idx", "locus").select("x", "m", "units").collect()]
    assert rich == [(v, True, "um") for k in (3, 9, 4, 8) for v in (k + 0.5, k + 1.25)]
    assert quality.report(df.drop("units", "path", "error"), standard()).count() == 5


def test_options_choose_files(spark, folder):
    (folder / "bad_0_A1.txt").write_text("nothing")
    some = read(spark, folder, subjects="s1, s2,s9", segments="A1")
    assert {r[0] for r in some.select("subject_id").distinct().collect()} == {"s1", "s2"}
    assert some.where("subject_id = 's1'").count() == 120 and some.count() == 240  # predicates of one scan don't stay for the next
    assert read(spark, folder, subjects="none").count() == 0
    assert read(spark, folder, partitionBytes="500", subjects="s0,s1,s2").rdd.getNumPartitions() == 3


def test_modes(spark, folder):
    (folder / "bad_0_A1.txt").write_text("nothing")
    with pytest.raises(Exception, match="bad_0_A1.txt: no rows of numbers"):
        read(spark, folder).count()
    assert read(spark, folder, mode="dropmalformed").where("subject_id = 'bad'").count() == 0
    row = read(spark, folder, mode="PERMISSIVE").where("subject_id = 'bad'").collect()
    assert len(row) == 1 and row[0]["error"] == "ValueError: no rows of numbers" and row[0]["t_idx"] is None and row[0]["x"] is None
    with pytest.raises(Exception, match="40 samples where the protocol has 8000"):
        spark.read.format("maskwave").options(**X.options(standard(), strict="true", subjects="s1")).load(str(folder)).count()
    with pytest.raises(Exception, match="unknown mode"):
        read(spark, folder, mode="other").count()
    with pytest.raises(Exception, match="fs"):
        spark.read.format("maskwave").load(str(folder)).count()


def test_a_format_of_the_users_own(spark, folder):
    class Semicolons(X.ExportFormat):
        name = "semicolons"

        def keys(self, filename):
            return (filename[:-4], "9", "V1") if filename.endswith(".sem") else None

        def matrix(self, text):
            return np.array([[float(v) for v in line.split(";")] for line in text.split()])

    (folder / "x7.sem").write_text("1;2\n3;nan\n")
    X.register(spark, Semicolons)
    rows = [tuple(r) for r in read(spark, folder, "semicolons").select("subject_id", "visit_id", "vessel_type", "t_idx", "locus", "x", "m").orderBy("t_idx", "locus").collect()]
    assert rows == [("x7", "9", "vein", 0, 0, 1.0, True), ("x7", "9", "vein", 0, 1, 2.0, True), ("x7", "9", "vein", 1, 0, 3.0, True), ("x7", "9", "vein", 1, 1, None, False)]


def test_cells_come_back_as_they_were_written(spark, folder):
    cells = read(spark, folder).drop("path")
    path = str(folder / "again")
    X.together(cells).write.format("maskwave").mode("append").save(path)
    assert sorted(p.name for p in (folder / "again").iterdir()) == [f"s{k}_0_A1.txt" for k in range(4)] + ["s9_1_V3.txt"]
    back = read(spark, path).drop("path")
    assert back.exceptAll(cells).isEmpty() and cells.exceptAll(back).isEmpty()
    with pytest.raises(Exception, match="not together"):
        cells.coalesce(1).orderBy("t_idx", "subject_id").coalesce(1).write.format("maskwave").mode("append").save(str(folder / "torn"))
    assert not [p for p in (folder / "torn").iterdir() if p.suffix == ".txt"]


def test_both_parsers_agree(spark):
    rng = np.random.default_rng(3)
    pick = lambda *x: x[rng.integers(0, len(x))]
    files = []
    for k in range(60):
        width, lines = int(rng.integers(2, 5)), []
        for _ in range(12):
            cells = [f"{v:.2f}".replace(".", pick(".", ",")) for v in rng.normal(100, 30, width)]
            gap = pick("\t", "\t", " ", "   ", ";")
            if gap == "\t":
                cells = [c if j == 0 or rng.random() > 0.2 else pick("", "n.a.", "-") for j, c in enumerate(cells)] + ["x"] * int(rng.random() < 0.15)
            if gap == ";":
                cells = [c.replace(",", ".") for c in cells]
            lines.append(gap.join(cells) if rng.random() > 0.05 or not lines else "\t\t")
        lines.append("\t".join(["1,5"] * width))
        files.append((f"/x/s{k}_0_A1.txt", HEAD + "\n".join(lines)))
    got = reader.parse(spark.createDataFrame(files, "path string, content string"), standard()).collect()
    by = {}
    for r in got:
        by.setdefault(r["subject_id"], {})[r["t_idx"], r["locus"]] = r["x"]
    form = X.ExportFormat(X.Options(fs=25.0))
    for path, text in files:
        table = form.matrix(text)
        want = {(i, j): None if math.isnan(v) else v for i, row in enumerate(table) for j, v in enumerate(row)}
        mine = by[path.split("/")[-1].split("_")[0]]
        assert {k: v for k, v in mine.items() if v is not None} == {k: v for k, v in want.items() if v is not None}, text
        assert len({t for t, _ in mine}) == len(table)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1\t2\n3\t4\n", [[1, 2], [3, 4]]),
        ("h\n1.5 2\n3 nan\n\n5 6\n", [[1.5, 2], [3, None], [5, 6]]),
        ("1\t2\n3\t4\t5\n6\n", [[1, 2], [6, None]]),
        ("a\nb\nc\nd\n1,5;2\n3;4,5\n", [[1.5, 2], [3, 4.5]]),
        ("a\nb\nc\nd\n1,5\t2\n3\tx\n\t\n4\t5\t\t\n", [[1.5, 2], [3, None], [None, None], [4, 5]]),
        ("\n".join(f"{k / 25}\t{k % 3}" for k in range(20)), [[k % 3] for k in range(20)]),
    ],
)
def test_tables(text, want):
    got = X.ExportFormat(X.Options(fs=25.0)).matrix(text)
    assert np.where(np.isnan(got), None, got).tolist() == want


def test_a_row_with_further_numbers_is_an_error_of_tolerant_files():
    with pytest.raises(ValueError, match="3 numbers where others have 2"):
        X.ExportFormat(X.Options(fs=25.0)).matrix("a\nb\nc\nd\n1,5\t2\n3\t4\n1\t2\t3\n")
