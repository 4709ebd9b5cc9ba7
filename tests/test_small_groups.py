"""N-grams of small groups are counted in one row, those of large ones over all partitions: the same numbers."""

import random

from effnum.operators import lexical


def _docs(spark):
    draw = random.Random(3)
    rows = []
    for g in range(40):
        for d in range(draw.randrange(0, 7)):
            rows.append((g, d, " ".join(draw.choice("abcde") for _ in range(draw.randrange(0, 12)))))
    rows += [(90, 1, "a b c d"), (90, 2, "a b c d"), (91, 1, None), (91, 2, "a b"), (92, 1, "a a a b"), (92, 2, "a b b")]
    return spark.createDataFrame(rows, "g int, doc_id int, text string")


def test_small_groups_equal_large_ones(spark, monkeypatch):
    docs = _docs(spark)
    monkeypatch.setattr(lexical, "GROUP_TOKENS", -1)
    spread = {(r.g, r.doc_id): r.bleu for r in lexical.document_bleu(docs, ["g"]).collect()}
    for bound in (9, 1 << 14):  # some groups in one row, and all of them
        monkeypatch.setattr(lexical, "GROUP_TOKENS", bound)
        found = {(r.g, r.doc_id): r.bleu for r in lexical.document_bleu(docs, ["g"]).collect()}
        assert found.keys() == spread.keys()
        assert all(abs(found[k] - spread[k]) < 1e-12 for k in found)


def test_small_groups_shuffle_words_not_ngrams(spark):
    plan = lexical._bleu_of_groups  # the route by rows exists and is taken: no n-gram is a row of it
    assert callable(plan)
    docs = spark.createDataFrame([(1, 1, "a b"), (1, 2, "a c")], "g int, doc_id int, text string")
    out = lexical.document_bleu(docs, ["g"])
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "bleu(" in text
    assert sorted(round(r.bleu, 6) for r in out.collect()) == sorted(
        round(r.bleu, 6) for r in lexical._spread_bleu(docs, ["g"], "doc_id", "text", 4, True).collect()
    )


def test_distinct_counts_words_of_several_places(spark):
    """Bigrams travel as hashes of their words; groups without any keep a row."""
    docs = spark.createDataFrame([(1, 1, "a b a b"), (1, 2, "ab a"), (2, 1, "x"), (3, 1, None)], "g int, doc_id int, text string")
    found = {r.g: (r.n_total, r.n_distinct, r.value) for r in lexical.distinct_n(docs, ["g"], n=2).collect()}
    assert found == {1: (4, 3, 0.75), 2: (0, 0, 0.0), 3: (0, 0, 0.0)}
    assert "concat_ws" not in lexical.distinct_n(docs, ["g"], n=2)._jdf.queryExecution().optimizedPlan().toString()
