"""Operator 8: near-duplicate groups by SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, hot_keys, spread_join, table, written

# Words of a shingle, seed of its hash, bits that linked fingerprints may differ in.
SHINGLE, SEED, DISTANCE = 3, 42, 3
#: A bucket with more fingerprints than this is split by the bits that its members don't share yet.
BUCKET = 256
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ONE = np.uint64(1)


def fingerprint_of(text: str | None, n: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the hashes of the shingles; no words: 0."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return bits_of(np.fromiter((digest(line[s:e], SEED) for s, e in zip(begins, ends[n - 1 :].tolist(), strict=True)), np.uint64, len(begins)))


def bits_of(h: np.ndarray) -> int:
    """Each bit that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        part = h[k : k + (1 << 15)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((counts * 2 > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Adds ``out``, the fingerprint of each whole text as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(out, of(F.col(text).cast("string")))


def _variants(level: int, distance: int):
    """Rows (fp, key, free) to rows of the next level: the free bits are cut into segments so few that in one of them two linked
    fingerprints differ by a bit at most; each segment gives a row for each of its bits, with that bit left out."""
    segments = (distance + 2) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            free = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for mask in np.unique(free):
                rows = free == mask
                bits = [b for b in range(64) if int(mask) >> b & 1]
                for k in range(segments):
                    part = bits[k * len(bits) // segments : (k + 1) * len(bits) // segments]
                    whole = sum(1 << b for b in part)
                    for b in part:
                        kept = np.uint64(whole & ~(1 << b))
                        tag = np.uint64((level << 40 | k << 20 | b) * 0x9E3779B97F4A7C15 % (1 << 64))
                        x = (fp[rows] & kept) ^ tag ^ (key[rows] * np.uint64(0xD6E8FEB86659FD93))
                        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                        left = np.full(len(x), int(mask) & ~int(kept), np.uint64)
                        yield pa.record_batch([pa.array(fp[rows].view(np.int64)), pa.array((x ^ (x >> np.uint64(32))).view(np.int64)), pa.array(left.view(np.int64))], ["fp", "key", "free"])

    return run


def _forest(values: list[int], distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints: a link for each that joins two parts, not one for each pair."""
    fp = np.unique(np.array(values, np.int64)).view(np.uint64)
    todo, out = np.ones(len(fp), bool), []
    for root in range(len(fp)):
        if not todo[root]:
            continue
        todo[root] = False
        stack = [root]
        while stack:
            i = stack.pop()
            near = np.flatnonzero(todo & (np.bitwise_count(fp ^ fp[i]) <= distance))
            todo[near] = False
            out += [(int(fp[i].view(np.int64)), int(x)) for x in fp[near].view(np.int64)]
            stack += near.tolist()
    return out


def links(distinct: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose connected parts are those of all pairs of distinct fingerprints within the distance.

    Buckets of up to ``bucket`` fingerprints are verified whole. A larger one shares all but its free bits, so it is cut again by
    those; after a few levels the free bits alone bound a bucket. No bucket is dropped and none is collected before it is counted.
    """

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def forest(groups: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in _forest(g, distance)] for g in groups])

    rows = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("free"))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, level, width = None, 0, 64
    while True:
        # Few small rows become many here: they are dealt by another hash than the one they lie by, into a number of parts that stays.
        dealt = rows.repartition(parts, F.xxhash64("fp", F.lit(level)))
        rows = written(dealt.mapInArrow(_variants(level, distance), "fp long, key long, free long"), f"variants-{level}")
        segments = (distance + 2) // 2
        width = width - width // segments + 1
        last = 2 ** min(width, 40) <= 4 * bucket or width <= segments * 4
        small, hot = rows, None
        if not last:
            hot = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key"), f"hot-{level}")
            if hot.isEmpty():
                last = True
            else:
                small = rows.join(hot, "key", "left_anti")
        whole = small.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        new = written(whole.select(F.explode(forest("fps")).alias("l")).select("l.a", "l.b"), f"links-{level}")
        found = new if found is None else found.unionByName(new)
        if last:
            forget(rows)
            return found.distinct()
        rows, level = written(rows.join(hot, "key", "left_semi").select("fp", "key", "free"), f"split-{level}", instead_of=rows), level + 1


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over edges (a, b), for every node that has an edge.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller ones; a third of all nodes in one part
    converges in a number of rounds that grows with the logarithm of its size. The rounds end as soon as only stars are left, and links
    that are stars need none. Rounds are written tables, so lost executors only repeat one; nothing but sums come to the driver.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "links")
    n, unsettled = _unsettled(e)
    while unsettled:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        # A node that a large share of all edges ends in would be one task's work.
        hot = hot_keys(e.groupBy("v").agg(F.count("*").alias("n")), "v") if n > 200_000 else []
        large = spread_join(e, low, "v", hot, F.col("u")).select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hot = hot_keys(e.groupBy("u").agg(F.count("*").alias("n")), "u") if n > 200_000 else []  # the same nodes begin the new edges
        small = spread_join(large, least, "u", hot, F.col("v")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = written(small.select("x.u", "x.v").where("u <> v").distinct(), "round", instead_of=e)
        n, unsettled = _unsettled(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _unsettled(e: DataFrame) -> tuple[int, int]:
    """Edges (u, v), u > v, and nodes that are in the way of stars: those that hang on two others, or on one while others hang on them."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    nodes = e.select(ends.alias("p")).groupBy("p.x").agg(F.sum("p.up").alias("up"), F.max("p.down").alias("down"))
    n, unsettled = nodes.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return n or 0, unsettled


def near_duplicates(df: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp (signed long), component_id of every row of documents.

    component_id is the smallest doc_id that is reachable over links between fingerprints that differ in at most ``distance`` bits;
    equal fingerprints are linked. Texts are first reduced to distinct fingerprints, so thousands of copies count once; the rows of a hot
    fingerprint are dealt into parts where they meet its group again.

    Null and blank texts have fingerprint 0, linked like any other. Null ids belong to their group but are never its name, unless
    it has no other (then component_id is null). Repeated rows get the same group; extra columns are ignored; an empty table gives
    an empty result.
    """
    docs = fingerprints(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))).select("doc_id", "fp")
    docs = written(docs, "fingerprints")
    firsts = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    groups = components(links(firsts.select("fp"), distance, bucket))
    rooted = firsts.join(groups, firsts["fp"] == groups["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return spread_join(docs, named, "fp", hot_keys(firsts, "fp"), F.col("doc_id")).select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of all documents, fingerprints as hex digits."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
