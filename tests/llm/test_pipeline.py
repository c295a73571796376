"""The pipeline's stages on planted cases, one by one and together."""

import numpy as np
import pytest

import corpus_pipeline
from maskwave.llm import secrets

WORDS = np.random.default_rng(9).integers(0, 4000, 60_000)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    text = lambda k, n=60: " ".join(f"q{w}" for w in WORDS[k * 100 : k * 100 + n])
    rows = [(k, text(k), "en", f"s{k % 3}", 0) for k in range(200)]
    bad = "worthless idiot moron scum stupid".split()
    rows = [(i, f"{t} {' '.join(bad)}" if i % 5 == 0 else t, lang, s, n) for i, t, lang, s, n in rows]
    rows += [(300, text(1), "en", "s0", 0), (301, text(1), "en", "s1", 0), (302, f"{text(210)} {text(250, 20)} {text(211)}", "en", "s0", 0), (303, f"{text(212)} token=abcdef123456", "en", "s2", 0), (304, None, None, None, None), (305, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, text(250, 20))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_do_their_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns and ids(kept) == {i for i in ids(docs) if i >= 300 or i % 5}
    single = corpus_pipeline.drop_near_copies(spark, kept, folder)
    assert ids(kept) - ids(single) == {300, 301, 305} and single.columns == docs.columns
    clean = corpus_pipeline.drop_leaks(spark, single, folder)
    assert ids(single) - ids(clean) == {302}
    safe = corpus_pipeline.redact_secrets(spark, clean, folder)
    assert ids(safe) == ids(clean)
    row = safe.where("doc_id = 303").first()
    assert row["text"].endswith(" [assign]") and row["n_chars"] == len(row["text"]) and secrets.spans_of(row["text"]) == []
    assert safe.where("doc_id = 7").first()["text"] == docs.where("doc_id = 7").first()["text"]


def test_run_is_the_stages_in_order(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "mixing"]
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert not set(out["doc_id"]) & {300, 301, 302, 304, 305} and not any(k % 5 == 0 for k in out["doc_id"] if k < 200)
    taken = out.groupby("source")["size"].sum()
    for s, g in out.groupby("source"):
        assert abs(taken[s] - g["target"].iloc[0]) <= 70


def test_pipeline_on_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
