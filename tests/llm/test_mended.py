"""Cases that once lost rows, crashed or depended on where a text was cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from effnum.llm import forest, mixing, near_duplicates, topk_pivot, toxicity

VECTORS = "vec_id long, embedding array<double>"


def brute(rows, every, k, score):
    out = []
    for q, v in {(q, tuple(v)) for q, v in rows if q is not None and q % every == 0}:
        own = [(score(v, x), i) for i, x in rows if i != q and len(x) == len(v)]
        own.sort(key=lambda t: (-t[0], t[1] is None, t[1] or 0))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(own[:k])]
    return sorted(out, key=lambda t: t[:2])


def got(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=lambda t: t[:2])


def whole(v, x):
    from math import floor

    exact = sum(floor(256 * a) * floor(256 * b) for a, b in zip(v, x))
    return max(min(exact, (1 << 63) - 1), topk_pivot.NOTHING + 1)


def rows_with(extra, n=120, d=6, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in rng.normal(size=d)]) for i in range(n)] + extra


def test_repeated_rows_and_rows_without_id(spark):
    best = [9.0] * 6
    rows = rows_with([(7, best), (7, best), (7, best), (None, best), (None, [8.0] * 6), (50, best), (50, best)])
    df = spark.createDataFrame(rows, VECTORS)
    mine = [t for t in got(topk_pivot.digest(df)) if t[0] in (0, 100)]
    assert mine == [t for t in brute(rows, 50, 5, whole) if t[0] in (0, 100)]
    near = [(q, r, i) for q, r, i, _ in got(forest.digest(df)) if q in (20, 40, 60) and r <= 7]
    assert near == [(q, r, i) for q, r, i, _ in brute(rows, 20, 20, lambda a, b: float(np.dot(a, b))) if q in (20, 40, 60) and r <= 7]


@pytest.mark.parametrize("size", [1e6, 1e9, 1e17, 1e200])
def test_large_components(spark, size):
    """As a candidate and as a query, beside many small rows."""
    rows = rows_with([(33333, [size, 1.0, 0.0, 0.0, 0.0, 0.0]), (200, [-size, 0.0, 1.0, 0.0, 0.0, 0.0]), (250, [size, size, 0.0, 0.0, 0.0, 1.0])])
    assert got(topk_pivot.digest(spark.createDataFrame(rows, VECTORS))) == brute(rows, 50, 5, whole)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for high in (10, 2**26, 2**30, 2**45):
        q, v = (rng.integers(-high, high, (4, 5)).astype(np.float64) for _ in range(2))
        want = [[max(min(sum(int(a) * int(b) for a, b in zip(x, y)), 2**63 - 1), topk_pivot.NOTHING + 1) for y in v] for x in q]
        assert topk_pivot.products(q, v).tolist() == want


def test_toxicity_of_long_texts_ignores_the_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    table = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    words = [f"word{i % 700}é" for i in range(4000)] + ["x" * 900] + [f"word{i}é" for i in range(900)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    whole_text = toxicity.bag_means(data, np.array([0, len(data)]), table)[0]
    whole_bag = toxicity.bag(data)
    for piece in (64, 1000, 7777):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert toxicity.bag_means(data, np.array([0, len(data)]), table)[0] == pytest.approx(whole_text, abs=1e-12)
        assert all((a == b).all() for a, b in zip(toxicity.bag(data), whole_bag))


def test_bag_means_are_averages_over_n_grams():
    """Against a plain loop over the distinct words' n-grams, each word within its borders."""
    rng = np.random.default_rng(3)
    table = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    for text in ["", "a", "Ab ab AB", "the cat, the hat: über-straße 12", "zz " * 50]:
        data = np.frombuffer(text.encode(), np.uint8)
        folded = bytes(toxicity._FOLD[data]).split()
        numbers = []
        for word in dict.fromkeys(folded):
            own = b" " + word + b" "
            for n in toxicity.GRAMS:
                for i in range(len(own) - n + 1):
                    code = 0
                    for c in own[i : i + n]:
                        code = (code * 1_000_003 + c) & 0xFFFFFFFF
                    code = ((code ^ (code >> 15)) * 2654435761) & 0xFFFFFFFF
                    numbers.append(float(table[code >> (32 - toxicity.BITS)]))
        want = sum(numbers) / (len(numbers) + toxicity.NEUTRAL)
        assert toxicity.bag_means(data, np.array([0, len(data)]), table)[0] == pytest.approx(want, abs=1e-9)


def test_empty_texts_are_never_copied_beyond_the_cap(spark):
    rows = [(i, "" if i < 40 else "a few words here", "small") for i in range(44)] + [(100 + i, "many words " * 500, "large") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs)
    assert got.agg(F.max("__llm_copies")).first()[0] <= mixing.MAX_EPOCHS
    assert got.where("source = 'small'").agg(F.max("__llm_copies")).first()[0] == mixing.MAX_EPOCHS


def test_pairs_of_many_buckets_are_written_once_a_task(spark):
    """Sets 1, 2 and 3, 4 of two components meet in thirty buckets."""
    rows = spark.createDataFrame([(g, s, 1 if s < 3 else 3) for g in range(30) for s in (1, 2, 3, 4)], "g long, s long, c long")
    counts = spark.createDataFrame([(s, 100, bytearray([1] * near_duplicates.CELLS)) for s in (1, 2, 3, 4)], "s long, n long, k binary")
    pairs = near_duplicates._candidates(rows, counts).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.a, r.b) for r in pairs} == {(3, 1), (3, 2), (4, 1), (4, 2)}
    assert len(pairs) == len({(r.task, r.a, r.b) for r in pairs})


def test_toxicity_learns_in_a_task(spark, monkeypatch):
    """The driver gets the model, not the sample."""
    rows = [(i, f"vile awful words {i}" if i % 3 == 0 else f"kind and gentle words {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    frame = type(docs)

    def refuse(self):
        raise AssertionError("the sample came to the driver")

    monkeypatch.setattr(frame, "toArrow", refuse)
    table, bias = toxicity.fit(docs, labels)
    assert table.any() and np.isfinite(bias)
    assert not toxicity.fit(docs.where("doc_id < 0"), labels)[0].any()
