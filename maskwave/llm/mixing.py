"""Operator 10: mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, spark_words, table, written

# The weights of the sources in order, repeating; the share of all words; copies of a document at most.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
LEAF = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target, one row a source (null is a source, ordered last).

    ``sizes`` has source and size. Targets share ``share`` of all sizes by weight; one above ``most`` times its source's size stops
    there and its excess goes to the others by weight, until none is above. Each round is one aggregate over the table of sources;
    only three sums come to the driver. Sources are numbered by ranges: each part by itself, after the counts of the parts before it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = written(per.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}  # one number a part
    before = {p: sum(n for q, n in counts.items() if q < p) for p in counts}
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part")) if before else F.lit(0)
    place = (offset + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = ranged.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))).drop("part")
    per = written(per, "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    rate, full = 0.0, -1
    while True:
        capped = F.col("source_size") * float(most) <= F.col("weight") * rate
        held, free, n = per.agg(F.sum(F.when(capped, F.col("source_size") * float(most))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        if n == full or not free:
            break
        rate, full = max(0.0, share * total - (held or 0.0)) / free, n
    return per.select("source", "source_size", F.least(F.col("source_size") * float(most), F.col("weight") * rate).alias("target"))


def _coin(*parts) -> float:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big") / 2**64


def _pivot(group: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One pass over a group, largest sizes first: each open unit is paired with the pool of the smaller ones, and words are moved
    between the two, one way or the other, until one of them is integral.

    The pool's members share what it gains by their room and what it loses by their mass, so their masses stay an affine function of
    mass and size that the pass carries along. The chances of the two ways keep every unit's expectation (but for a unit so large that the
    pool can close it only one way, which happens in small groups: then that way is taken), and a group's sum of words never
    changes, so at most one unit, a small one, stays open."""
    group = group.sort_values(["size", "unit"], ascending=[False, True], kind="stable").reset_index(drop=True)
    mass, sizes, units = group["mass"].tolist(), group["size"].tolist(), group["unit"].tolist()
    tiny = 1e-7
    scale, lift = 1.0, 0.0
    room, held = float(sum(sizes)), float(sum(mass))
    for i, w in enumerate(sizes):
        m = min(max(scale * mass[i] + lift * w, 0.0), float(w))
        room, held = max(room - w, 0.0), max(held - m, 0.0)
        up, down, spare = w - m, m, max(room - held, 0.0)
        if (up <= held) != (down <= spare):  # the pool can take only one of the ways in full
            up, down = (0.0, down) if up > held else (up, 0.0)
            chance = float(up > 0)
        else:
            up, down = min(up, held), min(down, spare)
            chance = down / (up + down) if up + down > tiny else 0.0
        if up + down > tiny:
            if _coin(seed, units[i]) < chance:
                keep = 1 - up / held
                scale, lift, m, held = scale * keep, lift * keep, m + up, held - up
            elif down > 0:
                gain = down / (room - held)
                scale, lift, m, held = scale * (1 - gain), lift * (1 - gain) + gain, m - down, held + down
        mass[i] = 0.0 if m <= tiny else float(w) if m >= w - tiny else m
    group["mass"] = mass
    return group


def mix(df: DataFrame, seed: int = 7, leaf: int = LEAF, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row of documents.

    A document's expected copies are its source's target over its source's size. The whole part is taken at once; the fraction is a
    probability. Leaves of about ``leaf`` documents (a hash of the id, so a hot source has many) each leave at most one open
    document; the open ones meet in groups again, until a source has one, which is rounded to the nearer side. Sums of taken words
    thus differ from the target by less than half of one document, and coins are hashes, so reruns agree.

    Null and empty texts have size 0 and take nothing. A document is an id, a text and a source, so rows without an id, or of one id, are
    rounded each by its own text; rows that repeat one share what it takes, and differ by a copy at most. Extra columns are ignored. An
    empty table gives an empty result.
    """
    words = F.size(spark_words(F.col("text"))).cast("long")
    docs = df.select("doc_id", "source", words.alias("size"), F.xxhash64("text").alias("own"), F.monotonically_increasing_id().alias("row"))
    docs = written(docs, "sizes")  # the texts are read once
    targets = source_targets(docs, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    docs = docs.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")), "left").withColumn("rate", rate)
    unit = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("own").cast("string"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    whole = F.floor(F.col("rate") + 1e-12)
    docs = docs.withColumns({"unit": unit, "whole": whole, "part": F.greatest(F.col("rate") - whole, F.lit(0.0))})
    # Of rows that repeat a document, as many as their chances add up to are taken for certain, and the rest of the sum is one open unit.
    sums = docs.where((F.col("size") > 0) & (F.col("part") > 1e-12)).groupBy("unit").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.first("part").alias("part"), F.count("*").alias("rows"))
    sums = written(sums.withColumn("sure", F.floor(F.col("rows") * F.col("part") + 1e-12)), "units")
    left = F.greatest(F.col("rows") * F.col("part") - F.col("sure"), F.lit(0.0))
    units = sums.select("unit", "source", "size", (F.col("size") * left).alias("mass"))
    schema = "unit string, source string, size long, mass double, leaf long"
    level, settled = 0, None
    counted = units.groupBy("source").agg(F.count("*").alias("n"))
    widest = counted.agg(F.max("n")).first()[0] or 0
    open_ = units
    while widest:
        groups = -(-widest // leaf)
        sized = open_.groupBy("source").agg(F.ceil(F.count("*") / leaf).alias("leaves"))
        dealt = open_.join(sized.withColumnRenamed("source", "l_source"), F.col("source").eqNullSafe(F.col("l_source"))).select("unit", "source", "size", "mass", F.pmod(F.xxhash64("unit", F.lit(level)), "leaves").alias("leaf"))
        done = dealt.groupBy("source", "leaf").applyInPandas(lambda g: _pivot(g, seed), schema)
        done = written(done, f"mix-{level}")
        is_open = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
        if groups == 1:
            last = done.select("unit", F.round(F.col("mass") / F.col("size")).cast("int").alias("bit"))
        else:
            last = done.where(~is_open).select("unit", F.round(F.col("mass") / F.col("size")).cast("int").alias("bit"))
        settled = last if settled is None else settled.unionByName(last)
        open_, widest, level = done.where(is_open), 0 if groups == 1 else groups, level + 1
    if settled is None:
        settled = units.select("unit", F.lit(0).alias("bit")).limit(0)
    extra = written(sums.join(settled, "unit", "left").select("unit", "rows", (F.col("sure") + F.coalesce("bit", F.lit(0))).alias("extra")), "extra")
    given = docs.join(extra, "unit", "left")
    alone = given.where("rows is null or rows = 1").withColumn("bit", F.coalesce("extra", F.lit(0)))
    out = alone
    if not extra.where("rows > 1").isEmpty():
        # The rows are equal, so any of them may be the first; a document of very many is numbered in parts.
        many = given.where("rows > 1").withColumn("deal", F.pmod("row", F.lit(SALTS)))
        deals = many.groupBy("unit", "deal").agg(F.count("*").alias("held"))
        before = F.coalesce(F.sum("held").over(Window.partitionBy("unit").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nth = F.col("before") + F.row_number().over(Window.partitionBy("unit", "deal").orderBy("row"))
        many = many.join(deals.select("unit", "deal", before.alias("before")), ["unit", "deal"])
        out = alone.unionByName(many.withColumn("bit", (nth <= F.col("extra")).cast("long")).drop("deal", "before"))
    out = out.withColumn("copies", (F.col("whole") + F.col("bit")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
