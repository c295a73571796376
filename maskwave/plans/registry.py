"""Registration of queries, each with the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.protocol import Cycle, Protocol, standard
from ..operators.aggregates import aggregate_loci
from ..sources.cells import CELLS_SQL, from_events
from ..sources.shared import plain_unions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
P: Protocol = standard(fs=1.0)
SEG = ["subject_id", "visit_id", "segment_label"]
#: Relations ev, cells and tr (the median trace of each segment).
TRACES_SQL = CELLS_SQL + """,
tr AS (SELECT subject_id, visit_id, segment_label, vessel_type, t_idx, t, median(x) AS y FROM cells GROUP BY ALL)"""
IDS = "subject_id, visit_id, segment_label"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, in a session in which unions don't pass their inputs' partitioning on (``shared.plain_unions``)."""
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(load(spark, sf_dir, "events"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_loci(cells(spark, sf_dir)).withColumn("method", F.lit("raw"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def cycle_bounds(c: Cycle) -> dict[str, float]:
    base = P.baseline_of(c)
    return {"k": c.index, "bs": base.start, "be": base.end, "fs": c.flicker.start, "fe": c.flicker.end, "rs": c.recovery.start, "re": c.recovery.end}


def over_cycles(select: str) -> str:
    """A SELECT for each cycle, with its bounds filled in, all together."""
    return " UNION ALL ".join("(" + select.format(**cycle_bounds(c)) + ")" for c in P.cycles)
