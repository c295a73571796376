"""The long table of cells: one row for each segment, time and locus, with value and observed flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["subject_id", "visit_id", "segment_label"]
# Labels and event types of the adapter, in order.
LABELS = ("A1", "A2", "V3", "V4")
LOCI = ("click", "error", "purchase", "signup", "view")
SLOTS = 360


def vessel_type(label: Column) -> Column:
    first = F.upper(F.substring(F.trim(label), 1, 1))
    return F.when(first == "A", "artery").when(first == "V", "vein").otherwise("unknown")


def is_artery(kind: Column, label: Column) -> Column:
    return F.lower(kind).startswith("a") | F.upper(label).startswith("A")


def is_vein(kind: Column, label: Column) -> Column:
    return F.lower(kind).startswith("v") | F.upper(label).startswith("V")


def complete(observed: DataFrame, slots: int, loci: int, fs: float) -> DataFrame:
    """Adds the cells that no row names, as not observed: a grid from each segment's key alone, then one join on it."""
    keys = observed.select(*KEY).distinct()
    grid = keys.withColumn("t_idx", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("locus", F.explode(F.sequence(F.lit(0), F.lit(loci - 1))))
    out = grid.join(observed, [*KEY, "t_idx", "locus"], "left")
    return out.select(*KEY, vessel_type(F.col("segment_label")).alias("vessel_type"), "t_idx", (F.col("t_idx") / F.lit(float(fs))).alias("t"), "locus", "x", F.col("x").isNotNull().alias("m"))


def from_events(events: DataFrame) -> DataFrame:
    """Hours of events as time, 360 of them a subject; users as segments, event types as loci, the largest value as x."""
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3_600_000_000)
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    locus = F.array_position(F.array(*map(F.lit, LOCI)), F.col("event_type")).cast("int") - 1
    rows = events.where(F.col("ts").isNotNull() & F.col("user_id").isNotNull()).select(
        F.floor(hour / SLOTS).cast("string").alias("subject_id"),
        F.lit("0").alias("visit_id"),
        label.alias("segment_label"),
        F.pmod(hour, F.lit(SLOTS)).cast("int").alias("t_idx"),
        locus.alias("locus"),
        F.col("value").alias("x"),
    )
    seen = rows.where("locus >= 0").groupBy(*KEY, "t_idx", "locus").agg(F.max("x").alias("x"))
    return complete(seen, SLOTS, len(LOCI), 1.0)


#: The same cells in DuckDB, as the start of every oracle: relations ev, cells.
CELLS_SQL = """
WITH ev AS (
  SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS h, user_id % 4 AS s,
    list_position(['click','error','purchase','signup','view'], event_type) - 1 AS locus, value FROM events),
seen AS (
  SELECT CAST(h // 360 AS VARCHAR) AS subject_id, ['A1','A2','V3','V4'][s + 1] AS segment_label, CAST(h % 360 AS INTEGER) AS t_idx,
    CAST(locus AS INTEGER) AS locus, max(value) AS x FROM ev GROUP BY ALL),
keys AS (SELECT DISTINCT subject_id, segment_label FROM seen),
cells AS (
  SELECT k.subject_id, '0' AS visit_id, k.segment_label, CASE WHEN k.segment_label LIKE 'A%' THEN 'artery' ELSE 'vein' END AS vessel_type,
    CAST(a.t AS INTEGER) AS t_idx, CAST(a.t AS DOUBLE) AS t, CAST(b.l AS INTEGER) AS locus, x, x IS NOT NULL AS m
  FROM keys k, range(360) a(t), range(5) b(l) LEFT JOIN seen s
    ON s.subject_id = k.subject_id AND s.segment_label = k.segment_label AND s.t_idx = a.t AND s.locus = b.l)"""
