from collections import Counter

import numpy as np
import pytest

from effnum.operators import cooccur


def dense(texts, reach):
    n = Counter()
    for t in texts:
        words = (t or "").split()
        for i, a in enumerate(words):
            for b in words[i + 1 : i + 1 + reach]:
                n[a, b] += 1
                n[b, a] += 1
    names = sorted({a for a, _ in n})
    at = {w: k for k, w in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for (a, b), c in n.items():
        m[at[a], at[b]] = c
    with np.errstate(divide="ignore"):
        pmi = np.log(m * m.sum() / np.outer(m.sum(0), m.sum(0)))
    return n, names, np.maximum(pmi, 0.0)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    topics = [[f"w{t}x{k}" for k in range(7)] for t in range(5)]
    rows = []
    for k in range(60):
        topic = topics[k % 5]
        rows.append(" ".join(rng.choice([*topic, "the"], size=2 + 3 * (k % 4), p=[0.3, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05, 0.2])))
    return [*rows, None, "", "alone", "the the"]


def test_counts_and_vectors_equal_dense_ones(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    counts, names, pmi = dense(texts, 3)
    assert {(r.a, r.b): r.n for r in cooccur.cooccurrences(df, reach=3).collect()} == dict(counts)
    got = {r.word: np.array(r.vec) for r in cooccur.word_vectors(df, dim=4, reach=3, passes=25).collect()}
    assert set(got) == {*names, "alone"} and not got["alone"].any()
    u, s, _ = np.linalg.svd(pmi)
    want = u[:, :4] * np.sqrt(s[:4])
    have = np.stack([got[w] for w in names])
    # Inner products do not depend on signs.
    assert np.allclose(have @ have.T, want @ want.T, atol=1e-5)
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-3)


def test_small_and_empty_corpora(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id int, text string")
    got = {r.word: r.vec for r in cooccur.word_vectors(df, dim=3).collect()}
    assert set(got) == {"a", "b", "c"} and all(len(v) == 3 for v in got.values())
    assert got["c"] == [0.0] * 3 and sum(x * x for x in got["a"]) == pytest.approx(np.log(2), rel=1e-6)
    assert {r.word for r in cooccur.word_vectors(df, dim=3, min_count=2).collect()} == {"a", "b"}
    assert cooccur.word_vectors(df.limit(0), dim=3).collect() == []


def test_pairs_are_not_broadcast(spark, texts):
    # Spark's estimate of an exploded table is that of its input, far below what 13 million pairs take.
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    plan = cooccur.associations(cooccur.cooccurrences(df, reach=3))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2
