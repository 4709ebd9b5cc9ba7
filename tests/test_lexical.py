import math
from collections import Counter

import pytest

from effnum.functions import text as tx
from effnum.operators import lexical


def corpus(spark, groups):
    rows = [(g, i, t) for g, texts in groups.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "g string, doc_id long, text string")


def values(df):
    return {r["g"]: r["value"] for r in df.collect()}


def test_ratios(spark):
    df = corpus(
        spark,
        {
            "same": ["word word", "word word"],
            "cats": ["the cat sat", "the cat ran"],
            "mixed": ["hello, world!"],
            "none": ["...", "!?"],
            "accents": ["Café café CAFÉ"],
        },
    )
    ttr = values(lexical.type_token_ratio(df, ["g"]))
    assert ttr["same"] == 0.25 and ttr["mixed"] == 1.0 and ttr["none"] == 0.0
    assert ttr["accents"] == pytest.approx(1 / 3)
    assert values(lexical.distinct_n(df, ["g"], n=2))["cats"] == 0.75
    assert values(lexical.distinct_n(df, ["g"], n=5))["cats"] == 0.0
    assert values(lexical.type_token_ratio(df, ["g"], lowercase=False))["accents"] == 1.0
    rough = values(lexical.type_token_ratio(df, ["g"], approximate=True))
    assert rough["same"] == 0.25
    assert lexical.type_token_ratio(df).collect()[0]["value"] == pytest.approx(8 / 15)


def bleu(docs, i, max_n=4):
    hyp, refs = docs[i], [d for j, d in enumerate(docs) if j != i]

    def grams(t, n):
        return Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))

    logs = 0.0
    for n in range(1, max_n + 1):
        best = Counter()
        for r in refs:
            for g, c in grams(r, n).items():
                best[g] = max(best[g], c)
        own = grams(hyp, n)
        hit = sum(min(c, best[g]) for g, c in own.items())
        if n == 1 and hit == 0:
            return 0.0
        logs += math.log((hit or 0.1) / max(1, sum(own.values()))) / max_n
    ref = min((len(r) for r in refs), key=lambda x: (abs(x - len(hyp)), x))
    return math.exp(logs) * (1.0 if len(hyp) > ref else math.exp(1 - ref / len(hyp)))


def test_self_bleu_equals_definition(spark):
    groups = {
        "a": ["the cat sat on the mat", "the cat sat on a mat", "a dog ran", "the the the cat", "a dog ran"],
        "short": ["one two", "one two three", "one"],
        "apart": ["alpha beta", "gamma delta"],
        "single": ["only one here"],
        "blank": ["...", "a b c"],
    }
    got = values(lexical.self_bleu(corpus(spark, groups), ["g"]))
    for g, texts in groups.items():
        docs = [d for d in (t.split() for t in texts if t != "...") if d]
        want = sum(bleu(docs, i) for i in range(len(docs))) / len(docs) if len(docs) > 1 else 0.0
        assert got[g] == pytest.approx(want, abs=1e-9), g


def test_ngrams_of_short_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    rows = [r[0] for r in df.select(tx.ngrams(df.t, 2)).collect()]
    assert rows == [["a b", "b c"], [], []]


def test_cleaning_and_splitting(spark):
    df = spark.createDataFrame([("One...<br/>two!Three  four? ",)], "text string")
    row = df.select(
        tx.clean_text("text").alias("c"), tx.clauses("text").alias("s"), tx.sentences(tx.clean_text("text")).alias("e")
    ).first()
    assert row.c == "One. two! Three four?"
    assert row.s == ["One", "<br/>two", "Three  four"]
    assert row.e == ["One.", "two!", "Three four?"]


def test_word_statistics(spark):
    df = spark.createDataFrame([("ABC Def ghi 1a2 ghi",), ("",), ("a b c d e f g h i j k",)], "text string")
    rows = df.select(
        tx.shape_variety("text").alias("s"),
        tx.unique_word_ratio("text").alias("u"),
        tx.length_proxy("text").alias("l"),
        tx.word_chunks("text").alias("c"),
    ).collect()
    assert rows[0].s == 0.75 and rows[0].u == 0.8 and rows[0].l == 0.25
    assert rows[1].s == 0.0 and rows[1].u == 0.0 and rows[1].c == []
    assert rows[2].c == ["a b c", "d e f", "g h i", "j k"]
