"""Operator 2: removal of repeated substrings, found by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, hot_keys, rolling, spread_join, table, word_hashes, word_hashes_128, words_of, written

# Words of a window; a period and a cover such that every difference modulo the period is one of two members.
WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Words of an anchor: two equal windows share one that starts at a cover position of both, within a period of their starts.
ANCHOR = WINDOW - PERIOD + 1
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64), pa.int64())


def cover_positions(n_words: int) -> np.ndarray:
    at = np.arange(max(n_words - ANCHOR + 1, 0), dtype=np.int64)
    return at[np.isin(at % PERIOD, COVER)] if n_words >= WINDOW else at[:0]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            if len(words) >= WINDOW:
                at = cover_positions(len(words))
                out.append((rolling(word_hashes(words), ANCHOR, FIRST)[at], np.full(len(at), row, np.int64), at))
            if sum(len(x[0]) for x in out[-64:]) > 100_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


def _rows(parts) -> pa.RecordBatch:
    h, row, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.record_batch([_long(h), pa.array(row), pa.array(at.astype(np.int32))], ["h", "row", "at"])


def candidates(n_words: int, shared: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold, within a period of their start, an anchor that occurs elsewhere too."""
    if n_words < WINDOW or not len(shared):
        return np.zeros(0, np.int64)
    edge = np.zeros(n_words + 2, np.int32)
    at = np.asarray(shared, np.int64)
    np.add.at(edge, np.maximum(at - PERIOD + 1, 0), 1)
    np.add.at(edge, at + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: n_words - WINDOW + 1] > 0)


#: Bits of a place inside a text, where a document's number and it fit one long.
AT_BITS = 24


def _windows(packed: bool):
    """Extends shared anchors to whole windows: 128 bits of each, from two independent hashes of its words, with its place: the document's
    number and the position, packed into one long or beside each other."""

    def made(parts) -> pa.RecordBatch:
        h1, h2, key, tie, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        if packed:
            return pa.record_batch([_long(h1), _long(h2), pa.array(key << AT_BITS | at)], ["h1", "h2", "place"])
        return pa.record_batch([_long(h1), _long(h2), pa.array(key), pa.array(tie), pa.array(at)], ["h1", "h2", "key", "tie", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, tie, text, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                at = candidates(len(words), np.array(shared, np.int64))
                if len(at):
                    one, two = word_hashes_128(words)
                    out.append((rolling(one, WINDOW, FIRST)[at], rolling(two, WINDOW, SECOND)[at], np.full(len(at), key, np.int64), np.full(len(at), tie, np.int64), at))
                if sum(len(x[0]) for x in out[-64:]) > 100_000:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    return run


def keep_mask(n_words: int, shared, firsts) -> np.ndarray:
    """True for each word that no window covers whose words also start earlier."""
    at = candidates(n_words, np.array(shared if shared is not None else [], np.int64))
    later = np.setdiff1d(at, np.array(firsts if firsts is not None else [], np.int64))
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, later, 1)
    np.add.at(edge, later + WINDOW, -1)
    return np.cumsum(edge)[:n_words] == 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n, removed, kept = [], [], [], []
        for doc_id, text, shared, firsts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = words_of(text)
            keep = keep_mask(len(words), shared, firsts)
            ids.append(doc_id)
            n.append(len(words))
            removed.append(len(words) - int(keep.sum()))
            kept.append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode("utf-8"))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row of documents.

    A window is 20 consecutive words; a word goes if some window over it has the same words as one that starts earlier, in a smaller
    doc_id or before it in the same text. Judged on the input, so overlapping repeats don't hide each other.

    Three steps, each distributed by hashes or rows: anchors (runs of 8 words at cover positions modulo 13) that occur twice or more;
    their extension to windows, of which a map-side combined minimum finds the first; the words left. A passage in a third of all
    texts is one row a task in both aggregates; where its anchors meet the shared ones they are dealt into parts. What a task holds
    is one batch of texts.

    Null texts have no words. Null ids come last in the order. Rows without an id, and rows that share one, are documents of their own,
    ordered by a hash of their texts; rows that repeat id and text are one document, given as often. Texts under 20 words lose nothing.
    Extra columns are ignored; an empty table gives an empty result.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"key": doc_key(F.col("doc_id")), "hash": F.xxhash64("text")})
    # Where every row has an id and every id one text, the ids alone order the documents, and place in text and id fit one long.
    known = docs.groupBy("key").agg((F.min("hash") != F.max("hash")).alias("many"), F.max(F.octet_length("text")).alias("most"))
    many, low, high, most = known.agg(F.max("many"), F.min("key"), F.max("key"), F.max("most")).first()
    packed = not many and low is not None and low >= 0 and high < 1 << (62 - AT_BITS) and (most or 0) < 1 << (AT_BITS + 1)
    tie = F.when(F.col("doc_id").isNull() | F.lit(bool(many)), F.col("hash")).otherwise(F.lit(0).cast("long"))
    docs = docs.withColumn("tie", F.lit(0).cast("long") if packed else tie)
    docs = docs.withColumn("row", F.col("key") if packed else F.xxhash64("key", "tie")).drop("hash")
    anchors = docs.select("row", "text").mapInArrow(_anchors, "h long, row long, at int")
    places = written(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "places")
    met = spread_join(anchors, places.select("h"), "h", hot_keys(places, "h"), F.struct("row", "at"))
    shared = written(met.groupBy("row").agg(F.collect_list("at").alias("shared")), "anchors")
    ready = docs.select("row", "key", "tie", "text").join(shared, "row").select("key", "tie", "text", "shared")
    if packed:
        windows = ready.mapInArrow(_windows(True), "h1 long, h2 long, place long")
        first = windows.groupBy("h1", "h2").agg(F.min("place").alias("place")).select(F.shiftright("place", AT_BITS).alias("row"), F.col("place").bitwiseAND((1 << AT_BITS) - 1).alias("at"))
    else:
        windows = ready.mapInArrow(_windows(False), "h1 long, h2 long, key long, tie long, at long")
        first = windows.groupBy("h1", "h2").agg(F.min(F.struct("key", "tie", "at")).alias("first")).select(F.xxhash64("first.key", "first.tie").alias("row"), "first.at")
    marks = written(shared.join(first.groupBy("row").agg(F.collect_list("at").alias("firsts")), "row", "left"), "windows")
    return docs.join(marks, "row", "left").select("doc_id", "text", "shared", "firsts").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``remove_repeats`` of all documents."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 19) AS x
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM win),
gone AS (
  SELECT DISTINCT doc_id, i + d AS p FROM (SELECT doc_id, i, unnest(range(0, 20)) AS d FROM ranked WHERE k > 1)),
words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS body FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""
