"""Sources of results that are there already: traces, parameter tables and flat result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import KEY

TRACE_COLUMNS = (*KEY, "vessel_type", "method", "t_idx", "t", "y")
PARAMETER_COLUMNS = (*KEY, "vessel_type", "method", "cycle_index", "ok", "error", "error_stage")


def _holding(df: DataFrame, names: tuple[str, ...], what: str) -> DataFrame:
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"{what} without {', '.join(lacking)}")
    return df


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Denoised traces of an earlier run, as ``sinks.write_parquet`` leaves them."""
    return _holding(spark.read.parquet(path), TRACE_COLUMNS, "traces")


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """A parameter table of an earlier run."""
    return _holding(spark.read.parquet(path), PARAMETER_COLUMNS, "a parameter table")


def read_csv(spark: SparkSession, path: str, schema: str, nested: dict[str, str] | None = None) -> DataFrame:
    """A flat result file of ``sinks.write_csv`` under a known schema; ``nested`` gives the types of columns that hold JSON."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return df.withColumns({n: F.from_json(n, t) for n, t in (nested or {}).items()})
