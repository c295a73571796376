"""Queries of readers: exports through the data source and its writer, and every branch of the line parser."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.protocol import Protocol
from ..sources import exports as X
from ..sources import reader as R
from ..sources.shared import folder
from .registry import load, query

_FILES = 50
_PLACED = f"SELECT *, row_number() OVER (PARTITION BY o_custkey % {_FILES} ORDER BY o_orderkey) - 1 AS k FROM orders"
_IDS = f"'S' || o_custkey % {_FILES} AS subject_id, '0' AS visit_id, 'V3' AS segment_label, 'vein' AS vessel_type, CAST(k AS INTEGER) AS t_idx, k / 25.0::DOUBLE AS t"


@query(
    "export_format_cells",
    f"""WITH o AS ({_PLACED}) SELECT {_IDS}, CAST(l AS INTEGER) AS locus, CASE WHEN l = 1 AND o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(12, 2)) + l AS DOUBLE) END AS x,
  NOT (l = 1 AND o_orderkey % 7 = 0) AS m, 'a.u.' AS units, CAST(NULL AS VARCHAR) AS error FROM o, range(2) r(l)""",
)
def export_format_cells(spark, sf_dir):
    """Orders as exports of 50 segments, written by the format's writer to the shared folder and read back through its reader."""
    o = load(spark, sf_dir, "orders").select((F.col("o_custkey") % _FILES).alias("s"), "o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    second = F.when(F.col("o_orderkey") % 7 != 0, (F.col("price") + 1).cast("double"))
    cells = o.select(F.concat(F.lit("S"), F.col("s").cast("string")).alias("subject_id"), F.lit("0").alias("visit_id"), F.lit("V3").alias("segment_label"), F.col("o_orderkey").alias("t_idx"), F.posexplode(F.array(F.col("price").cast("double"), second)).alias("locus", "x"))
    path = folder(spark, "exports")
    X.register(spark)
    X.together(cells).write.format("maskwave").mode("append").save(path)
    return spark.read.format("maskwave").option("fs", "25").load(path).drop("path")


@query(
    "export_line_branches",
    f"""WITH o AS ({_PLACED}), v AS (SELECT *, [CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE), CASE WHEN o_orderkey % 5 = 3 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(12, 2)) + 1 AS DOUBLE) END] AS xs FROM o)
SELECT {_IDS}, CAST(l AS INTEGER) AS locus, xs[l + 1] AS x, xs[l + 1] IS NOT NULL AS m FROM v, range(2) r(l)""",
)
def export_line_branches(spark, sf_dir):
    """Orders as lines of every kind that the parser knows: tabs with decimal commas, blanks, numbers among other characters, a missing cell,
    and a row with a further cell that holds nothing."""
    o = load(spark, sf_dir, "orders").select((F.col("o_custkey") % _FILES).alias("s"), "o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    a, b, kind = F.col("price").cast("string"), (F.col("price") + 1).cast("string"), F.col("o_orderkey") % 5
    line = F.when(kind == 0, F.replace(F.concat(a, F.lit("\t"), b), F.lit("."), F.lit(","))).when(kind == 1, F.concat(a, F.lit("  "), b))
    line = line.when(kind == 2, F.concat(F.lit("+"), a, F.lit(";"), b, F.lit(";"))).when(kind == 3, F.concat(a, F.lit("\tn.a."))).otherwise(F.concat(a, F.lit("\t"), b, F.lit("\t-")))
    path = F.concat(F.lit("/data/S"), "s", F.lit("_0_V3.txt"))
    return R.parse(R.built(o, path, "o_orderkey", line, "Diameters complete\nname\n\n1 -> position"), Protocol("p", 25.0)).drop("dropped")
