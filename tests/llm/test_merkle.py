"""The Merkle manifest against a plain construction, with odd rows, deep trees and many small ones."""

import hashlib
import zlib
from collections import Counter

import pytest

from effnum.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def sides(tree, i):
    for level in tree[:-1]:
        a = i // 3 * 3
        yield level[a:i], level[i + 1 : a + 3]
        i //= 3


def plain(rows):
    """The digest's rows, built directly. rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault("" if r[1] is None else "s" + r[1], []).append(r)
    trees = {}
    for k, rs in by.items():
        rs.sort(key=lambda r: ((r[0] is not None, r[0] or 0), leaf_of(r)))
        trees[k] = levels([leaf_of(r) for r in rs])
    names = sorted(by, key=lambda k: k.encode())
    top = levels([trees[k][-1][0] for k in names])
    root = top[-1][0]
    out = []
    for t, k in enumerate(names):
        for i, r in enumerate(by[k]):
            steps = [*sides(trees[k], i), *sides(top, t)]
            now = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                now = leaf_of((*r[:4], r[4].replace("\n", "")))
            for before, after in steps:
                now = sha("".join(before) + now + "".join(after))
            proof = "".join("".join(b) + "".join(a) for b, a in steps)
            out.append((r[0], leaf_of(r), trees[k][-1][0], root, sha(proof), now, now == root))
    return out


def compare(spark, rows, extra=False):
    columns = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows] if extra else rows, columns + (", leaf string, k int" if extra else ""))
    got = merkle.digest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain(rows))
    return got


ODD = [
    (1, "a", "en", 3, "x\ny"),
    (1, "a", "en", 3, "x\ny"),  # repeated
    (1, "a", "en", 4, "x\nyz"),  # same id
    (None, "a", None, None, None),
    (None, None, "de", 1, "\n"),
    (7, None, None, 0, ""),
    (8, "", "ü", 5, "ä\n🦆" * 20000),
    (9, "t", "en", 1, "no break"),
    (10, "s", "en", 1, "\n\n\n"),
    (11, "é", "en", 1, "a\n"),
    (12, "zz", "en", 1, None),
]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 11])
def test_odd_rows(spark, size):
    compare(spark, ODD[:size], extra=size == 11)


def test_empty_table(spark):
    columns = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.digest(spark.createDataFrame([], columns)).count() == 0


@pytest.mark.parametrize("levels_at_once", [1, 2, 6])
def test_sizes_around_runs(spark, monkeypatch, levels_at_once):
    """Sources of 1 to 28 documents, one of 82: every shape of a last run."""
    monkeypatch.setattr(merkle, "LEVELS", levels_at_once)
    monkeypatch.setattr(merkle, "SALT_FROM", 2)  # salted joins
    rows = [(1000 * s + i, f"src{s}", "en", i, f"text\n{i}") for s in [*range(1, 11), 27, 28, 82] for i in range(s)]
    compare(spark, rows)


def test_whole_run_of_many_levels(spark):
    """Exactly 3 ** 6 leaves and one more: the borders of a task's run."""
    rows = [(i, "a", None, None, f"{i}\n") for i in range(729)] + [(i, "b", None, None, f"{i}") for i in range(730)]
    got = compare(spark, rows).collect()
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_proofs_double_their_distance(spark):
    """A tree of 7 levels needs three joins, not seven."""
    nodes = spark.createDataFrame([("sa", i, b"%032d" % i) for i in range(800)], "k string, i long, d binary")
    from pyspark.sql import functions as F

    below, root = merkle.forest(nodes.select("k", "i", F.lit(0).alias("h"), "d"))
    assert root["h"] == 7
    proofs = merkle.proofs(below, root)
    got = {r["i"]: bytes(r["seg"]) for r in proofs.collect()}
    assert len(got) == 800
    for i in (0, 1, 400, 799):
        assert merkle.fold(b"%032d" % i, got[i])[1] == bytes(root["d"])
        assert merkle.fold(b"%032d" % (i + 1), got[i])[1] != bytes(root["d"])
