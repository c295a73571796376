"""Rows without an id, and texts that share one, through the stages that drop and join."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from maskwave.llm import common, decontaminate, repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_go_by_their_own_text(spark, tmp_path):
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    item = text("item", 20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    halves = " ".join(item.split()[:12]), " ".join(item.split()[8:])
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (1, text("c")), (2, text("c")), (2, text("d")), (3, text("e")), (3, text("f")), (None, f"{text('g')} {item}"), (4, f"{text('h')} {item}"), (4, text("i")), (5, f"{text('j')} {halves[0]}"), (5, f"{text('k')} {halves[1]}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    seen = lambda d: Counter((r["doc_id"], r["text"]) for r in d.collect())
    single = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert seen(single) == Counter(set(rows) - {(2, text("c"))})
    clean = corpus_pipeline.drop_leaks(spark, single, str(tmp_path))
    assert seen(clean) == Counter(r for r in seen(single) if item not in r[1])


def test_mixed_rows_are_the_rounded_ones(spark):
    rows = [(None, " ".join(f"t{k}-{j}" for j in range(20)), "en", "s" if k % 3 else None, 0) for k in range(60)]
    rows += [(7, " ".join(f"u{k}-{j}" for j in range(20)), "en", "s", 0) for k in range(30)]
    out = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), "").toPandas()
    for source in ("s", None):
        mine = out[out["source"].isna()] if source is None else out[out["source"] == source]
        assert abs(mine["size"].sum() - mine["target"].iloc[0]) <= 20
    assert out.groupby(["text", "copy"]).size().max() == 1


def test_repeats_of_rows_without_an_id_of_their_own(spark):
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 9000, n)]
    shared = words(60)
    rows = [(i, " ".join([*words(int(rng.integers(0, 40))), *shared[: int(rng.integers(20, 60))], *words(int(rng.integers(0, 900)))])) for i in (None, None, None, 7, 7, 7, 8, None)]
    rows += [(None, " ".join(shared)), (7, " ".join(shared)), rows[0], rows[3]]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    tie = {r["text"]: r["h"] for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie[r[1]])):
        w = t.split()
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, t, s))
    want = Counter()
    for i, t in rows:
        w = t.split()
        gone = {k for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (i, t, s) for k in range(s, s + 20)}
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert Counter(tuple(r) for r in repeats.remove_repeats(frame).collect()) == want


def test_leaks_of_rows_without_an_id_of_their_own(spark):
    item = [f"item{k}" for k in range(20)]
    parts = [" ".join(item[:12]), " ".join(item[8:]), " ".join(item), "other " * 30]
    rows = [(None, t) for t in parts] + [(5, t) for t in parts] + [(None, parts[2])]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, parts[2])], "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_shared"], r["n_shingles"]) for r in got) == [("5", 16, 16), ("None", 16, 16)]


def test_hot_keys_are_dealt(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = common.hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), "k")
    assert hot == [0] and sorted(common.spread_join(left, right, "k", hot, F.col("id")).collect()) == sorted(left.join(right, "k").collect())


def test_gzip_members_are_unpacked_in_bounded_memory():
    import gzip
    import resource
    import zlib

    from maskwave.llm import media

    deflate = zlib.compressobj(9, zlib.DEFLATED, 31)
    zeros = bytes(1 << 20)
    packed = b"".join(deflate.compress(zeros) for _ in range(300)) + deflate.flush()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = media.parts_of(b"ab" + packed + b"tail")
    assert [(p[1], p[2]) if isinstance(p, tuple) else p for p in found] and any(len(packed) in tuple(p) for p in found)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000
    short = gzip.compress(b"some text")
    assert any(len(short) in tuple(p) for p in media.parts_of(short + short[:-3]))
    assert not media.parts_of(packed[:-20])
