"""The pipeline's near copies against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from maskwave.llm import near_copies, simhash


def test_near_copies_are_pairs_at_the_similarity(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 900, 400)]
    change = lambda words, at: " ".join("other" + w if k in at else w for k, w in enumerate(words))
    jaccard = lambda a, b: len(set(near_copies.shingle_set(a)) & set(near_copies.shingle_set(b))) / len(set(near_copies.shingle_set(a)) | set(near_copies.shingle_set(b)))
    other = [[f"v{k}-{j}" for j in range(300)] for k in range(12)]
    texts = [" ".join(base), change(base, {10, 60, 110, 160, 210, 260, 310, 360}), change(base, set(range(5, 400, 40)) | {200}), "", " \n", None]
    for words in other:
        texts += [" ".join(words), change(words, {20, 60, 100, 140, 180, 220}), change(words, set(range(4, 300, 25)))]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), None).collect()}
    top = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if not (a or "").strip() and not (b or "").strip() or (a or "").strip() and (b or "").strip() and jaccard(a, b) >= 0.8:
                top = [min(top[i], top[j]) if x in (top[i], top[j]) else x for x in top]
    assert kept == set(top) and 0 < sum(x != k for k, x in enumerate(top)) < len(texts)


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_blocks_of_a_large_group(spark, block):
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(["x"] * k + words[k:]) for k in range(0, 200, 8)] + ["alone in this table of texts"]
    got = near_copies.near_copies(spark.createDataFrame([(t,) for t in texts], "text string"), block).collect()
    assert len(got) == len(texts) - 1 and len({r["root"] for r in got}) == 1


@pytest.mark.parametrize("shape", ["none", "loops", "stars", "chain", "random"])
def test_components_are_a_plain_union(spark, shape):
    rng = np.random.default_rng(5)
    edges = {
        "none": [],
        "loops": [(3, 3), (4, 4)],
        "stars": [(k, k % 3) for k in range(3, 30)] * 2,
        "chain": [(k, k + 1) if k % 2 else (k + 1, k) for k in range(60)],
        "random": [tuple(map(int, p)) for p in rng.integers(-40, 40, (45, 2))],
    }[shape]
    top = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in top:
        for a, b in edges:
            if a != b:
                top[a] = top[b] = min(top[a], top[b])
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(top) and {r["node"]: r["root"] for r in got} == top
