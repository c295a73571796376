"""Results kept to compare later ones with: goldens in Parquet, and comparisons with a tolerance for each column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = ("double", "float", "tinyint", "smallint", "int", "bigint", "decimal")


def write(df: DataFrame, path: str) -> None:
    """Keeps a result as a golden; one that is there stays."""
    df.write.mode("errorifexists").parquet(path)


def differences(found: DataFrame, golden: DataFrame, keys: list[str], relative: float = 1e-10, absolute: float = 0.0, by_column: dict[str, float] | None = None) -> DataFrame:
    """keys, column, golden, found, off: cells that are not the same. Numbers may be off by ``absolute`` and by ``relative`` (or the column's own
    in ``by_column``) of the golden; NULL and NaN are the same as each other alone; all else must be equal. A row of one side alone differs in
    column NULL, as do rows whose key a side has more than once.

    One full outer join on the keys, NULL meeting NULL; columns of one side alone are an error."""
    columns = [c for c in golden.columns if c not in keys]
    if sorted(found.columns) != sorted(golden.columns):
        raise ValueError(f"columns {sorted(found.columns)} where the golden has {sorted(golden.columns)}")
    pack = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.first(F.struct(*columns)).alias(name))
    a, b = pack(golden, "golden"), pack(found, "found").withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    both = a.join(b, on, "full_outer").select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], "n_golden", "n_found", "golden", "found")
    types, cells = dict(golden.dtypes), []
    nothing = F.lit(None)
    for c in columns:
        x, y = F.col(f"golden.{c}"), F.col(f"found.{c}")
        off = nothing.cast("double")
        if types[c].startswith(NUMBERS):
            x, y = (F.when(~F.isnan(v.cast("double")), v.cast("double")) for v in (x, y))
            off = F.abs(x - y)
            near = off <= absolute + (by_column or {}).get(c, relative) * F.abs(x)
            same = F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(near)
        else:
            same = x.eqNullSafe(y)
        cells.append(F.when(~same, F.struct(F.lit(c).alias("column"), x.cast("string").alias("golden"), y.cast("string").alias("found"), off.alias("off"))))
    alone = F.col("n_golden").eqNullSafe(F.lit(1).cast("long")) & F.col("n_found").eqNullSafe(F.lit(1).cast("long"))
    count = F.array(F.struct(nothing.cast("string").alias("column"), F.col("n_golden").cast("string").alias("golden"), F.col("n_found").cast("string").alias("found"), nothing.cast("double").alias("off")))
    found_ = F.when(alone, F.filter(F.array(*cells), lambda d: d.isNotNull())).otherwise(count)
    return both.select(*keys, F.explode(found_).alias("d")).select(*keys, "d.*")


def check(spark: SparkSession, found: DataFrame, path: str, keys: list[str], **tolerance) -> None:
    """Raises with the first differences from a kept golden."""
    off = differences(found, spark.read.parquet(path), keys, **tolerance).limit(5).collect()
    if off:
        raise AssertionError("; ".join(str(tuple(r)) for r in off))
