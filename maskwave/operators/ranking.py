"""Places, medians, bootstrap intervals and signed ranks of groups of any size: no group is ever in one task.

Distinct values are counted, sorted by ranges of group and value, and numbered within each range after the counts of the ranges before
it. What a group needs of its rows is then a handful of sums or a lookup of a few thousand places.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.shared import written
from . import kernels as K


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which NULL meets NULL, with the keys of the left side."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.lit(True))
    return left.join(other, on, how).drop(*[f"__{k}" for k in keys])


def places(df: DataFrame, by: list[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """by, value, n, the sums, low, high: each distinct value of a group with the first and last place that its rows take when the group
    is sorted, counted from 1. Rows without a value are left out; a written table."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in (sums or {}).items()])
    ranged = written(counted.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id()), "values")
    order = W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a range that holds some of the group
    before = ranged.groupBy(*by, "part").agg(F.sum("n").alias("within")).withColumn("before", F.coalesce(F.sum("within").over(order), F.lit(0))).drop("within")
    here = F.sum("n").over(W.partitionBy(*by, "part").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    out = same(ranged.withColumn("here", here), before, [*by, "part"])
    high = F.col("before") + F.col("here")
    return written(out.select(*by, value, "n", *(sums or {}), (high - F.col("n") + 1).alias("low"), high.alias("high")), "places")


def looked_up(places_: DataFrame, wanted: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, place, value for the places that ``wanted`` (by, place, size of the group) names.

    Places meet in blocks of an eighth of the root of the group's size: a bootstrap's places spread over half that root, so about as many
    rows meet a place in the largest groups as in small ones."""
    width = F.greatest(F.floor(F.sqrt("size") / 8), F.lit(1).cast("long"))
    asked = wanted.withColumn("block", F.floor(F.col("place") / width)).select(*by, "place", "block", "size").distinct()
    blocks = asked.select(*by, "block", "size").distinct()
    sizes = asked.select(*by, "size").distinct()
    there = same(places_, sizes, by).withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    there = same(there, blocks.drop("size"), [*by, "block"], "left_semi")
    met = same(asked.drop("size"), there.select(*by, "block", "low", "high", value), [*by, "block"])
    return met.where("place between low and high").select(*by, "place", value)


def _draws(by: list[str], resamples: int, seed: int):
    def run(frames):
        """(by, lo, hi, times): the middle places of each resample of a group, and times 0 for those of the group itself.

        A resample draws as many rows as there are, each any row; sorted, its k-th is row floor(size U) + 1 where U is the k-th of as
        many sorted uniform numbers, which is a beta variate. So a resample's median takes one or two draws, whatever the size."""
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                n, keys = int(row.size), [getattr(row, k) for k in by]
                rng = np.random.default_rng([seed, zlib.crc32(repr(keys).encode())])
                k = (n + 1) // 2
                first = rng.beta(k, n - k + 1, resamples)
                second = first + (1 - first) * rng.beta(1, n - k, resamples) if n % 2 == 0 else first
                pairs = np.minimum(np.floor(np.column_stack([first, second]) * n).astype(np.int64) + 1, n)
                pairs, times = np.unique(pairs, axis=0, return_counts=True)
                pairs, times = np.vstack([pairs, [[k, n // 2 + 1]]]), np.append(times, 0)
                out.append(pd.DataFrame({**dict(zip(by, ([v] * len(pairs) for v in keys), strict=True)), "lo": pairs[:, 0], "hi": pairs[:, 1], "times": times, "size": n}))
            yield pd.concat(out) if out else pd.DataFrame(columns=[*by, "lo", "hi", "times", "size"])

    return run


def median_interval(df: DataFrame, by: list[str], value: str, resamples: int = 5000, seed: int = 0) -> DataFrame:
    """by, size, median, ci_low, ci_high: each group's median and the 2.5 and 97.5 percentiles of its resamples' medians.

    Draws depend on seed and group alone. Rows without a value are left out; a group with none has no row."""
    found = places(df, by, value)
    sizes = found.groupBy(*by).agg(F.max("high").alias("size"))
    types = dict(df.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in by) + "lo long, hi long, times long, size long"
    drawn = written(sizes.mapInPandas(_draws(by, resamples, seed), schema), "draws")
    wanted = drawn.select(*by, F.explode(F.array("lo", "hi")).alias("place"), "size").distinct()
    at = written(looked_up(found, wanted, by, value), "at")
    both = same(same(drawn, at.withColumnsRenamed({"place": "lo", value: "v_lo"}), [*by, "lo"]), at.withColumnsRenamed({"place": "hi", value: "v_hi"}), [*by, "hi"])
    mid = F.when(F.col("lo") == F.col("hi"), F.col("v_lo")).otherwise((F.col("v_lo") + F.col("v_hi")) / 2)
    both = both.withColumn("mid", mid.cast("double"))
    limits = [F.percentile("mid", F.lit(q), F.col("times")).alias(n) for n, q in (("ci_low", 0.025), ("ci_high", 0.975))]  # ``resamples`` numbers a group
    return both.groupBy(*by).agg(F.first("size").alias("size"), F.max(F.when(F.col("times") == 0, F.col("mid"))).alias("median"), *limits)


def signed_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n_all, n, w_plus, w_minus, ties: the signed-rank sums of each group with mean ranks of ties; n leaves zeros out, ties is the sum of
    t^3 - t over groups of t equal sizes."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.abs(value).alias("size"), F.signum(value).alias("sign"))
    found = places(rows.where("sign <> 0"), by, "size", {"plus": F.count_if(F.col("sign") > 0)})
    rank, t = (F.col("low") + F.col("high")) / 2, F.col("n").cast("double")
    sums = found.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(rank * F.col("plus")).alias("w_plus"), F.sum(rank * (F.col("n") - F.col("plus"))).alias("w_minus"), F.sum(t * t * t - t).alias("ties"))
    every = rows.groupBy(*by).agg(F.count("*").alias("n_all"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)
    return same(every, sums, by, "left").select(*by, "n_all", zero("n", "long"), zero("w_plus", "double"), zero("w_minus", "double"), zero("ties", "double"))


@F.pandas_udf(DoubleType())
def signed_rank_p(n_all: pd.Series, n: pd.Series, plus: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p of ``signed_ranks``; NULL without a difference."""
    p = [K.signed_rank_p(int(a), int(b), float(w), float(t)) for a, b, w, t in zip(n_all, n, plus, ties, strict=True)]
    return pd.Series([None if x != x else x for x in p], dtype=object)
