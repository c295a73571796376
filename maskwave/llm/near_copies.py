"""Near copies of the pipeline's stage: texts that share 80 % of their five-word shingles, verified on whole sets.

Candidates are texts whose five-word SimHash fingerprints operator 8 links, and texts whose MinHash bands meet, which finds the pairs
that lie further apart than its radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, rolling, spread_join, word_hashes, written
from .simhash import DISTANCE, bits_of, components, links

# Words of a shingle and the Jaccard similarity of two near copies, as 4/5.
SHINGLE, PART, WHOLE = 5, 4, 5
#: Bands and minima of each: a pair at 0.8 shares no band with a chance of (1 - 0.8 ** 6) ** 32, 6 in 100,000; above 0.8 with less.
BANDS, MINIMA = 32, 6
#: Shingles that a task compares at once; a larger group of candidates is dealt into chunks of so many.
CHUNK = 1 << 20
#: Texts of a larger group that all others meet first.
PIVOTS = 32
_RNG = np.random.default_rng(8)
_TIMES = _RNG.integers(0, 1 << 31, BANDS * MINIMA).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, BANDS * MINIMA).astype(np.uint32)
_MULTIPLIER = 0x9E3779B97F4A7C15


def text_key(text: Column) -> Column:
    """128 bits of a text as hex digits; null and blank texts share ""."""
    return F.when(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == "", "").otherwise(F.md5(text))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's runs of five lower-cased words; a shorter text is one run."""
    words = text.lower().encode("utf-8", "replace").split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolling(word_hashes(words), min(SHINGLE, len(words)), _MULTIPLIER))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A number for each band of minima; none for a text without words."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * MINIMA, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(h), 64):
        np.minimum(low, (h[k : k + 64, None] * _TIMES + _PLUS).min(axis=0), out=low)
    rows = np.ascontiguousarray(low.reshape(BANDS, MINIMA).astype("<u4"))
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


class _Sets:
    """Sets of shingles side by side: how many members each shares with one of them, in one pass over all."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.codes = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
        self.begins = np.cumsum(self.size) - self.size
        self.held = np.zeros(int(self.codes.max()) + 1, bool)

    def near(self, i: int, among: np.ndarray) -> np.ndarray:
        """Which of the sets marked in ``among`` are at the similarity with set i."""
        mine = self.codes[self.begins[i] : self.begins[i] + self.size[i]]
        self.held[mine] = True
        both = np.add.reduceat(self.held[self.codes], self.begins, dtype=np.int64)
        self.held[mine] = False
        return np.flatnonzero(among & ((PART + WHOLE) * both >= PART * (self.size + self.size[i])))


def verified(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at the similarity: every pair is compared whose two texts no other pair has linked yet."""
    held = _Sets(sets)
    todo, out = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not todo[root]:
            continue
        todo[root] = False
        stack = [root]
        while stack and todo.any():
            i = stack.pop()
            near = held.near(i, todo)
            todo[near] = False
            out += [(i, int(j)) for j in near]
            stack += near.tolist()
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        fp = np.array([bits_of(s) for s in sets], np.uint64).view(np.int64)
        yield pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["t", "size", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(t).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.record_batch([*batch.columns[:-1], pa.array(found, pa.binary())], [*batch.schema.names[:-1], "shingles"])


def _of(group: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in group["shingles"]]


def _edges(names: list, pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame([(names[i], names[j]) for i, j in pairs], columns=["a", "b"], dtype=object)


def _small(group: pd.DataFrame) -> pd.DataFrame:
    return _edges(group["t"].tolist(), verified(_of(group)))


def _asked(group: pd.DataFrame) -> pd.DataFrame:
    """Links of the rows marked ``asks`` with the chunk's others; a text asks no more for those that it has reached."""
    group = group.sort_values("asks", ascending=False, kind="stable").drop_duplicates("t").reset_index(drop=True)
    names, held, pairs = group["t"].tolist(), _Sets(_of(group)), []
    label = np.arange(len(group))
    for i in range(int(group["asks"].sum())):
        for j in held.near(i, label != label[i]):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                pairs.append((i, int(j)))
    return _edges(names, pairs)


def candidate_links(banded: DataFrame) -> DataFrame:
    """a, b: links, some repeated, whose connected parts hold every two texts that share a band or whose fingerprints operator 8 links."""
    rows = banded.select("a", F.explode("bands").alias("band"))
    by_band = written(rows.groupBy("band").agg(F.min("a").alias("b"), F.max("a").alias("most"), F.count("*").alias("n")).where("b < most").select("band", "b", "n"), "shared-bands")
    met = spread_join(rows, by_band.drop("n"), "band", hot_keys(by_band, "band"), F.col("a")).where("a <> b").select("a", "b")
    prints = banded.select("fp", "a").distinct()
    firsts = written(prints.groupBy("fp").agg(F.min("a").alias("b"), F.count("*").alias("n")), "prints")
    equal = spread_join(prints, firsts.drop("n"), "fp", hot_keys(firsts, "fp"), F.col("a")).where("a <> b").select("a", "b")
    near = links(firsts.select("fp"), DISTANCE).select(F.col("a").alias("x"), F.col("b").alias("y"))
    named = near.join(firsts.select(F.col("fp").alias("x"), F.col("b").alias("a")), "x").join(firsts.select(F.col("fp").alias("y"), "b"), "y")
    return met.unionByName(equal).unionByName(named.select("a", "b"))


def near_copies(texts: DataFrame, chunk: int = CHUNK, pivots: int = PIVOTS) -> DataFrame:
    """node, root: text keys (``text_key``) of all texts that have a near copy with another key, and the smallest key of their group.

    Candidates form parts that hold every two texts that meet (``candidate_links``). A part's texts are compared on their whole sets of
    shingles, so only pairs at the similarity link, and a group is what those pairs connect. A part of over ``chunk`` shingles is dealt
    into chunks: all its texts meet about ``pivots`` of them, and those that the largest group doesn't hold then meet all others, block
    by block; pairs inside a group that is already one are not compared. No part, band or pair is dropped.

    Null and blank texts are nobody's copy; repeated texts count once; extra columns are ignored; an empty table gives an empty result.
    """
    keyed = texts.select(text_key(F.col("text")).alias("t"), F.col("text").cast("string").alias("text")).where("t <> ''")
    banded = written(keyed.mapInArrow(_signed, "t string, size long, fp long, bands array<long>").select("t", F.xxhash64("t").alias("a"), "size", "fp", "bands"), "bands")
    parts = components(candidate_links(banded))
    found = written(banded.select("t", "a", "size").distinct().join(parts, F.col("a") == F.col("node")).select("t", "root", "size"), "candidates")
    weight = written(found.groupBy("root").agg(F.sum("size").alias("whole"), F.count("*").alias("n")), "parts")
    # One row of each text, whatever its copies, meets the candidates.
    once = keyed.groupBy("t").agg(F.first("text").alias("text"))
    sets = spread_join(found, weight, "root", hot_keys(weight, "root"), F.col("t")).join(once, "t").select("t", "root", "whole", "n", "text").mapInArrow(_sets, "t string, root long, whole long, n long, shingles binary")
    sets = written(sets, "sets")
    pairs = sets.where(F.col("whole") <= chunk).select("root", "t", "shingles").groupBy("root").applyInPandas(_small, "a string, b string")
    big = sets.where(F.col("whole") > chunk)
    if not big.isEmpty():
        dealt = big.withColumn("chunks", F.ceil(F.col("whole") / chunk).cast("int")).withColumn("i", F.pmod(F.hash("t"), F.col("chunks")))
        first = F.pmod(F.xxhash64("t"), F.greatest(F.floor(F.col("n") / pivots), F.lit(1))) == 0
        met = written(_blocks(dealt, dealt.where(first).withColumns({"j": F.lit(0), "blocks": F.lit(1)})), "pivots")
        group = dealt.select("t", "root", "whole").join(components(met).withColumnRenamed("root", "g"), F.col("t") == F.col("node"), "left").select("t", "root", F.coalesce("g", "t").alias("g"))
        group = written(group, "grouped")
        largest = group.groupBy("root", "g").agg(F.count("*").alias("m")).groupBy("root").agg(F.max_by("g", F.struct("m", "g")).alias("g"))
        rest = written(dealt.join(group.join(largest, ["root", "g"], "left_anti").select("t"), "t"), "rest")
        size = rest.groupBy("root").agg(F.ceil(F.sum(F.octet_length("shingles")) / (8 * chunk)).cast("int").alias("blocks"))
        pairs = pairs.unionByName(met).unionByName(_blocks(dealt, rest.join(size, "root").withColumn("j", F.pmod(F.hash("t", F.lit(1)), F.col("blocks")))))
    return components(pairs)


def _blocks(dealt: DataFrame, asking: DataFrame) -> DataFrame:
    """Links of the asking texts (in blocks j of their part) with all texts of the part (in chunks i)."""
    blocks = asking.select("root", "blocks").distinct()
    asked = dealt.join(blocks, "root").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", "i", "j", "t", "shingles", F.lit(False).alias("asks"))
    asks = asking.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("root", "i", "j", "t", "shingles", F.lit(True).alias("asks"))
    return asked.unionByName(asks).groupBy("root", "i", "j").applyInPandas(_asked, "a string, b string")
