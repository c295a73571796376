"""Tables out: Parquet partitioned by method, flat CSV, wide pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({n: F.to_json(n) for n in nested})


def write_parquet(df: DataFrame, path: str, partitions: tuple[str, ...] = ("method",)) -> None:
    df.write.mode("errorifexists").partitionBy(*[p for p in partitions if p in df.columns]).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    flatten(df).write.mode("errorifexists").option("header", True).csv(path)


def widen(df: DataFrame, keys: list[str], names: str, value: str, listed: list[str]) -> DataFrame:
    """One column for each listed name: the names are a constant, so the pivot needs no pass to find them."""
    return df.groupBy(*keys).pivot(names, listed).agg(F.first(value))
