"""Quality rules: measurements against a plain definition, odd rows, policies and ablations from the bits."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from effnum.llm import quality_rules as q

SPACES = " \t\n\x0b\x0c\r"


def plain(text):
    """The measurements by their definitions."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(5)}
    seen, dup, lines = set(), 0, 0
    for line in (text or "").split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    echoes = sum(a == b for a, b in zip(words, words[1:]))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), lines, dup, len(inside), echoes)


ODD = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "a b c d e a b c d e",
    "a b c d e f\na b c d e f\n a b c d e f\n\n\n",
    "x x x x x x x",
    "über – straße 🦆    tab\tend # * $ % & | < >",
    "one two three four",
    "la " * 3000,
    " ".join(f"w{i}" for i in range(9000)) + "\n" + " ".join(f"w{i}" for i in range(9000)),
    "y" * 100_000,
]


def test_measurements(spark, monkeypatch):
    for text in ODD:
        assert q.measure(text) == plain(text)
    monkeypatch.setattr(q, "PIECE", 7)  # texts longer than a piece
    for text in ODD:
        assert q.measure(text) == plain(text)


def test_window_numbers_that_would_overflow():
    import numpy as np

    word = np.concatenate([np.arange(10_000), np.arange(9_990, 10_000), np.arange(20_000, 2, -3)])
    again = q.window_codes(word)
    tuples = [tuple(word[i : i + 5]) for i in range(len(word) - 4)]
    assert len(set(again.tolist())) == len(set(tuples))
    assert len(set(zip(again.tolist(), tuples))) == len(set(tuples))


def test_odd_rows(spark):
    rows = [(i, t, 1, "k") for i, t in enumerate(ODD)] + [(3, ODD[3], 2, "k"), (None, "a b c", 3, None), (None, None, 4, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits int, kept string")
    got = q.digest(docs).collect()
    assert Counter((r.doc_id, *[r[m] for m in q.MEASURES]) for r in got) == Counter((i, *plain(t)) for i, t, _, _ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = q.filtered(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in got)
    empty = q.digest(docs.limit(0))
    assert empty.count() == 0 and q.ablations(q.ledger(docs.limit(0))).count() == 0


def test_policies_and_ablations(spark):
    entries = spark.createDataFrame([(g, b) for g in "ab" for b in [0, 0, 1, 2, 3, 4, 64, 64 + 128, 64 + 128 + 256, 512]], "g string, bits long")
    got = {(r.g, r.version, r.rule): r for r in q.ablations(entries, by=["g"]).collect()}
    rows = [r.bits for r in entries.where("g = 'a'").collect()]

    def keeps(b, p):
        return not b & p.hard and (not p.weak or bin(b & p.weak).count("1") < p.limit)

    for p in q.POLICIES.values():
        for rule in q.RULES:
            bit = q.BIT[rule.name]
            if not (p.hard | p.weak) & bit:
                assert ("a", p.version, rule.name) not in got
                continue
            r = got["a", p.version, rule.name]
            without = q.Policy("", p.hard & ~bit, p.weak & ~bit, p.limit)
            assert r.n == len(rows)
            assert r.n_kept == sum(keeps(b, p) for b in rows)
            assert r.n_failed == sum(b & bit > 0 for b in rows)
            assert r.n_kept_without == sum(keeps(b, without) for b in rows)
            gone = [b for b in rows if not keeps(b, p)]
            ever, always = 0, -1
            for b in gone:
                ever, always = ever | b, always & b
            assert (r.ever, r.always) == (ever, always)


def test_stored_ledger_takes_new_policy(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    q.ledger(docs).write.parquet(str(tmp_path / "ledger"))
    stored = spark.read.parquet(str(tmp_path / "ledger"))
    for p in q.POLICIES.values():
        by_bits = stored.where(q.passes("bits", p)).select("doc_id").collect()
        assert by_bits == q.filtered(docs, p).select("doc_id").collect()


def test_ledger_plan_reads_texts_once(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = q.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("PythonUDF") >= 1
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


@pytest.mark.parametrize("keys", [["doc_id"], ["source", "doc_id"]])
def test_keys(spark, keys):
    docs = spark.createDataFrame([(1, "s", "a b")], "doc_id long, source string, text string")
    assert q.ledger(docs, keys).columns == [*keys, *q.MEASURES, "bits"]
    assert q.ledger(docs, keys).agg(F.sum("n_words")).first()[0] == 2
