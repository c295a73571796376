"""Operator 4: benchmark items inside documents, by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hot_keys, spread_join, table, written

# Words of a shingle, share of an item's shingles that a document must hold.
SHINGLE, CONTAINED = 5, 0.8
#: log2 of the bits of the filter that documents' shingles pass first: 4 MB, whatever the size of the benchmark.
FILTER_BITS = 25


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def shingles_of(text: str | None, n: int = SHINGLE) -> list[bytes]:
    """Runs of n lower-cased words joined by a space; a shorter text is one shingle; none for a blank text."""
    words = text.lower().encode("utf-8", "replace").split() if text else []
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= n:
        return [line]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - n + 1].tolist()
    return [line[s:e] for s, e in zip(begins, ends[n - 1 :].tolist(), strict=True)]


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, h, shingle: the distinct shingles of each item, hashes as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, _signed(xxhash.xxh64_intdigest(s)), s.decode()) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s in set(shingles_of(t))]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["item_id", "h", "shingle"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").mapInArrow(run, "item_id long, h long, shingle string").distinct()


def sketches(shingled: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """item_id, h, n, least: each item's smallest hashes, and how many of them a document with enough of the item must hold.

    Items are partitioned by size: a class holds those with as many shingles as between two powers of two, and its sketches have
    2m + 1 hashes, where m is the most shingles that the class's largest item may miss. A document that holds ``contained`` of an
    item misses at most its own m of them, so it holds at least size of the sketch less that many: no item is missed.
    """
    sized = shingled.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    top = F.pow(F.lit(2.0), F.ceil(F.log2("n")))  # the class's largest size
    spare = F.floor(top * (1 - contained) + 1e-9)
    keep = F.least(F.col("n"), 2 * spare + 1)
    missing = F.col("n") - F.ceil(F.col("n") * contained - 1e-9)
    ranked = sized.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy("h", "shingle")))
    return ranked.where(F.col("k") <= keep).select("item_id", "h", "n", F.greatest(keep - missing, F.lit(1)).alias("least"))


def rarest(sketched: DataFrame, found: DataFrame) -> DataFrame:
    """The part of each sketch that documents are looked up by: a document must hold ``least`` of it, so it holds one that is not among the
    least - 1 most frequent, and those that the fewest documents hold make the fewest candidates."""
    often = found.groupBy("h").agg(F.count("*").alias("often"))
    ranked = sketched.join(often, "h").withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("often"), "h")))
    return ranked.where(F.col("k") >= F.col("least")).select("item_id", "h", "n")  # hashes that no document holds are not there


def filter_bits(shingled: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of fixed size with the leading bits of every item's shingle hashes, or-ed in tasks and only then on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(held[at].astype(np.int16), pa.int16())], ["at", "byte"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    merged = shingled.select("h").mapInArrow(run, "at long, byte short").groupBy("at").agg(F.bit_or("byte").alias("byte"))
    got = merged.toArrow()
    out[got.column("at").to_numpy()] = got.column("byte").to_numpy().astype(np.uint8)
    return out


def leaks(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: every pair in which the document holds ``contained`` of the item's distinct shingles.

    Documents are read once, whole: their shingles pass a bitmap of fixed size and are written; the rarest hashes of the items' sketches meet
    them in an equi-join, and each candidate is verified on the item's whole set of shingles, as text and not as hashes.

    Null and blank texts hold nothing and are in nothing; null ids of items are skipped. A document is an id and a text: documents without
    an id come out with a null doc_id, each by its own text, and so do texts that share an id; rows that repeat an id and text are one
    document. Items under five words are one shingle. Extra columns are ignored. An empty table on either side gives an empty result.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("own"), "text")
    return held(keyed, items, contained, ("doc_id", "own")).drop("own")


def held(docs: DataFrame, items: DataFrame, contained: float = CONTAINED, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """As ``leaks``, for documents of key columns (which may be null) and a text; rows of equal keys count as one document."""
    spark = docs.sparkSession
    shingled = written(item_shingles(items), "items")
    bitmap = spark.sparkContext.broadcast(filter_bits(shingled))
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        shift = np.uint64(64 - FILTER_BITS)
        for batch in batches:
            rows, hs, texts = [], [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                parts = shingles_of(text)
                h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
                at = (h >> shift).astype(np.int64)
                hits = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                if len(hits):
                    mine = {int(h[k]): parts[k] for k in hits}
                    rows += [row] * len(mine)
                    hs += map(_signed, mine)
                    texts += [s.decode() for s in mine.values()]
            own = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            yield pa.record_batch([*own, pa.array(hs, pa.int64()), pa.array(texts, pa.string())], [*keys, "h", "shingle"])

    # Rows that repeat a document's keys give its shingles as often; they are put together by number and text, both of which are short.
    passed = docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{kinds}, h long, shingle string")
    found = written(passed.distinct().withColumn("doc", F.xxhash64(*keys)), "passed")
    index = written(rarest(sketches(shingled, contained), found), "index")
    common = hot_keys(found.groupBy("h").agg(F.count("*").alias("n")), "h")
    near = written(spread_join(found.select(*keys, "doc", "h"), index, "h", common, F.col("doc")).select(*keys, "doc", "item_id", "n").distinct(), "near")
    # An item that a large share of all candidates is about is dealt into parts.
    hot = hot_keys(near.groupBy("item_id").agg(F.count("*").alias("n")), "item_id")
    sets = shingled.groupBy("item_id").agg(F.collect_list(F.struct("h", "shingle")).alias("set"))
    whole = spread_join(near, sets, "item_id", hot, F.col("doc")).select(*keys, "doc", "item_id", "n", F.explode("set").alias("s")).select(*keys, "doc", "item_id", "n", "s.h", "s.shingle")
    there = found.select("doc", *[F.col(k).alias(f"f_{k}") for k in keys], "h", "shingle")
    same = [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in keys]
    on = (whole["doc"] == there["doc"]) & (whole["h"] == there["h"]) & (whole["shingle"] == there["shingle"])
    both = whole.join(there, on & same[0] if len(same) == 1 else on & same[0] & same[1])
    out = both.groupBy(*keys, "item_id").agg(F.first("n").alias("n_shingles"), F.count("*").alias("n_shared")).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return out.where(F.col("containment") >= contained - 1e-9).select(*keys, "item_id", "n_shingles", "n_shared", "containment")


def op4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``leaks`` of all documents and all benchmark items."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bs AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS s FROM b),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
ds AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS s FROM d),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles
HAVING count(*) / n_shingles >= 0.8 - 1e-9"""
