"""Operator 12: how far sources of a language are from each other and from it, over integer-coded terms."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_batches, written

# Fixed values of the contract: documents that a kept term occurs in at least, scale and smoothing of p, terms that a group reports.
LEAST_DOCS, SCALE, PRIOR, TOP = 30, 1_000_000_000, 5, 50
#: Terms of a chunk of the dictionary, and sources of a block: a task holds two matrices of BLOCK x WIDTH numbers.
WIDTH, BLOCK = 256, 256
#: Entries that a task counts before it hands them on.
HELD = 200_000

_OUTSIDE = [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: ASCII letters lower-cased, all other ASCII a blank, bytes of longer characters as they are.
FOLD = bytes(0x20 if b in _OUTSIDE else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
COUNTS = "lang string, source string, term binary, docs long, n long"
CODED = "lang string, chunk long, bi long, bj long, kind int, sid long, block long, id long, n long, total long"
FOUND = "lang string, sid long, part string, other long, value long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _counts(batches):
    """Documents and occurrences of each term by lang and source, summed within the task; a row without a term for each group."""
    docs, seen, held = defaultdict(Counter), defaultdict(Counter), 0

    def flush():
        for group, found in seen.items():
            terms = list(found)
            n, d = list(found.values()), docs[group]
            cols = [[group[0]] * (len(terms) + 1), [group[1]] * (len(terms) + 1), [*terms, None], [*(d[t] for t in terms), 0], [*n, 0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["lang", "source", "term", "docs", "n"])
        seen.clear()
        docs.clear()

    for batch in batches:
        text = batch.column(0).cast(pa.large_binary())
        for t, lang, source in zip(text, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            group, words = (lang, source), terms_of(t.as_py() or b"")
            before = len(seen[group])
            seen[group].update(words)
            docs[group].update(set(words))
            held += len(seen[group]) - before
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def _places(batches):
    """The place of each row within its partition."""
    at, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "part", "at"])
        at += n


def dictionary(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total, id: the kept terms of all languages, numbered in the order of language and UTF-8.

    Terms are sorted by ranges; each part numbers its own, after the counts of the parts before it (one number a part comes to the
    driver)."""
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs)
    ranged = kept.select("lang", "term", "total").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    placed = written(ranged.mapInArrow(_places, "lang string, term binary, total long, part long, at long"), "terms")
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("part").count().collect()):
        offsets += [F.lit(part), F.lit(before)]
        before += n
    offset = F.element_at(F.create_map(*offsets), F.col("part")) if offsets else F.lit(0)
    return placed.select("lang", "term", "total", (offset + F.col("at")).cast("long").alias("id"))


def shares(counts: np.ndarray, size, v: int) -> np.ndarray:
    """1 + floor(SCALE (count + PRIOR) / (size + PRIOR v)), exactly: in Python's integers where 64 bits would not hold a product."""
    if counts.size and int(counts.max()) + PRIOR >= (1 << 63) // SCALE:
        counts, size = counts.astype(object), np.asarray(size).astype(object)
    return (1 + (counts + PRIOR) * SCALE // (np.asarray(size) + PRIOR * v)).astype(np.int64)


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One chunk of a language's terms for two blocks of its sources: a dense matrix of shares a block, distances of each two
    sources over the chunk, and (where the blocks are one) each source's largest excesses over the language."""
    lang, _, bi, bj = key
    kind = rows["kind"].to_numpy()
    terms, groups, cells = (rows[kind == k] for k in (0, 1, 2))
    order = np.argsort(terms["id"].to_numpy())
    ids, totals = terms["id"].to_numpy()[order], terms["total"].to_numpy()[order]
    v, size = (int(groups["id"].iloc[0]), int(groups["total"].iloc[0])) if len(groups) else (0, 0)

    def block(b):
        g = groups[groups["block"] == b].sort_values("sid")
        sids, found = g["sid"].to_numpy(), cells[cells["block"] == b]
        counts = np.zeros((len(sids), len(ids)), np.int64)
        np.add.at(counts, (np.searchsorted(sids, found["sid"].to_numpy()), np.searchsorted(ids, found["id"].to_numpy())), found["n"].to_numpy())
        return sids, counts, shares(counts, g["n"].to_numpy()[:, None], v) if len(ids) else counts

    left, counts, p = block(bi)
    right, _, q = (left, counts, p) if bi == bj else block(bj)
    out = []
    for i, s in enumerate(left):
        far = np.abs(q - p[i]).sum(axis=1) if len(ids) else np.zeros(len(right), np.int64)
        keep = right > s
        one, value = right[keep], far[keep]
        out += [(s, "pair", one, value), (one, "pair", np.full(len(one), s), value)]
    if bi == bj and len(ids):
        whole = shares(totals, size, v)
        for i, s in enumerate(left):
            at = np.flatnonzero((counts[i] > 0) & (p[i] > whole))
            excess = (p[i] - whole)[at]
            best = np.lexsort((ids[at], -excess))[:TOP]
            out.append((s, "term", ids[at][best], excess[best]))
    made = [pd.DataFrame({"lang": lang, "sid": s, "part": part, "other": other, "value": value}) for s, part, other, value in out if len(other)]
    return pd.concat(made) if made else pd.DataFrame({"lang": pd.Series(dtype=object), "sid": pd.Series(dtype="int64"), "part": pd.Series(dtype=object), "other": pd.Series(dtype="int64"), "value": pd.Series(dtype="int64")})


def divergence(df: DataFrame, least_docs: int = LEAST_DOCS, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) its distance to each other source of the language (``pair``) and
    the terms that it uses most beyond the language, 50 at most (``term``).

    Texts are read once; a task sums terms of its groups before anything is shuffled, so a hot source or word sends a row a task. The
    kept terms of each language are sorted and numbered; numbers keep UTF-8 order, so ties of items are broken by number. A task
    compares two blocks of ``block`` sources on one chunk of ``width`` terms; sums over chunks are the distances. Each source is
    compared with each other of its language because the result has a row for each; nothing else of that size is made.

    Null text, lang and source are read as empty strings; a group without kept terms has only the smoothing, one of a language
    without kept terms distances of 0. Repeated rows count each; extra columns are ignored; an empty table gives an empty result.
    """
    text_batches(df.sparkSession)
    read = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = read.mapInArrow(_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    counts = written(counts, "term-counts")
    terms = dictionary(counts, least_docs).withColumn("chunk", F.floor(F.col("id") / width))
    coded = written(counts.where("term is not null").join(terms.drop("total"), ["lang", "term"]).select("lang", "source", "id", "chunk", "n"), "coded")

    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("whole"))
    sizes = coded.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.select("lang", "source").distinct().withColumn("sid", number.cast("long")).withColumn("block", F.floor(F.col("sid") / block))
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.select("lang", "source", "sid", "block", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "v", "whole")]), "groups")

    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    with_one = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("bi"), F.greatest(x, "block").alias("bj")))
    upward = F.transform(F.sequence(F.col("bi"), F.col("blocks") - 1), lambda x: x)
    none = F.lit(None).cast("long")
    at = ("lang", "chunk", "bi", "bj")
    # Each language has a chunk without terms too, so that sources without any kept term meet as well.
    chunks = terms.select("lang", "chunk").distinct().unionByName(blocks.select("lang", F.lit(-1).cast("long").alias("chunk")))
    dealt = terms.join(blocks, "lang").withColumn("bi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("bj", F.explode(upward))
    dealt = dealt.select(*at, F.lit(0).alias("kind"), none.alias("sid"), none.alias("block"), "id", none.alias("n"), "total")
    told = groups.join(blocks, "lang").withColumn("b", F.explode(with_one)).select("lang", "b.bi", "b.bj", "sid", "block", "size", "v", "whole").join(chunks, "lang")
    told = told.select(*at, F.lit(1).alias("kind"), "sid", "block", F.col("v").alias("id"), F.col("size").alias("n"), F.col("whole").alias("total"))
    cells = coded.join(groups.select("lang", "source", "sid", "block"), ["lang", "source"]).join(blocks, "lang").withColumn("b", F.explode(with_one))
    cells = cells.select("lang", "chunk", "b.bi", "b.bj", F.lit(2).alias("kind"), "sid", "block", "id", "n", none.alias("total"))
    found = written(dealt.unionByName(told).unionByName(cells).groupBy(*at).applyInPandas(_compare, FOUND), "distances")

    best_first = Window.partitionBy("lang", "sid").orderBy(F.col("value").desc(), "other")
    pairs = found.where("part = 'pair'").groupBy("lang", "sid", "part", "other").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(best_first))
    excesses = found.where("part = 'term'").withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= TOP)
    names = groups.select("lang", "sid", "source")
    pairs = pairs.join(names.select("lang", F.col("sid").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    excesses = excesses.join(terms.select("lang", F.col("id").alias("other"), F.col("term").cast("string").alias("item")), ["lang", "other"])
    wanted = ("lang", "sid", "part", "item", "value", "rank")
    return pairs.select(*wanted).unionByName(excesses.select(*wanted)).join(names, ["lang", "sid"]).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``divergence`` of all documents."""
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT i) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM k GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n) FILTER (k.term IS NOT NULL), 0) AS size
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) LEFT JOIN k USING (lang, term) LEFT JOIN l USING (lang) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(n.n, 0) + {PRIOR})) // (size + {PRIOR} * g.v) AS p,
    1 + ({SCALE}::HUGEINT * (k.total + {PRIOR})) // (l.whole + {PRIOR} * g.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
s AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM s QUALIFY part = 'pair' OR rank <= {TOP}"""
