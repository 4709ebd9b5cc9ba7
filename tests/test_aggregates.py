"""Medians, walks and clipped matches, each against a plain computation."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from effnum.operators import evaluate, graphs, lexical


def test_exact_median_of_a_hot_group(spark):
    # Half of all rows are one group, spread over 600 orders of magnitude, with many ties.
    rng = np.random.default_rng(3)
    hot = np.concatenate([10.0 ** rng.uniform(-300, 300, 20001), np.repeat(7.5, 9000)])
    rows = [("hot", float(x)) for x in hot]
    cold = {f"g{k}": rng.normal(size=k + 1).round(1).tolist() for k in range(40)}
    rows += [(g, x) for g, xs in cold.items() for x in xs]
    rows += [(None, 1.0), (None, 4.0), ("empty", None), ("gap", None), ("gap", 2.0)]
    rows += [("nan", float("nan"))] * 3 + [("nan", 1.0)] + [("late", float("nan")), ("late", 1.0), ("late", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(8)
    got = {r.g: (r.n, r.median) for r in evaluate.exact_median(df, ["g"], "x").collect()}
    assert got["hot"] == (29001, statistics.median(hot.tolist()))
    for g, xs in cold.items():
        assert got[g] == (len(xs), pytest.approx(statistics.median(xs), abs=1e-12))
    assert got[None] == (2, 2.5) and got["empty"] == (1, None) and got["gap"] == (2, 2.0)
    assert math.isnan(got["nan"][1]) and got["late"] == (3, 2.0)
    assert evaluate.exact_median(df.limit(0), ["g"], "x").collect() == []
    whole = evaluate.exact_median(df.where("not isnan(x)"), [], "x").first()
    assert whole.median == statistics.median([x for _, x in rows if x is not None and not math.isnan(x)])


def walked(links, order, thetas):
    around = {}
    for a, b in links:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    state = {v: [f(t * math.log1p(len(n))) for f in (math.cos, math.sin) for t in thetas] for v, n in around.items()}
    out = []
    for _ in range(order):
        state = {v: np.mean([state[u] for u in n], axis=0) for v, n in around.items()}
        out += list(np.mean(list(state.values()), axis=0))
    return out


def test_walks_of_large_graphs_take_a_few_waves_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    a, b, thetas = np.arange(1, 60), np.array([rng.integers(k) for k in range(1, 60)]), np.linspace(0.1, 2.5, 7)
    whole = graphs._walk(a, b, 3, thetas)
    monkeypatch.setattr(graphs, "WALK_CELLS", 250)  # two waves of 118 ends each
    assert np.allclose(graphs._walk(a, b, 3, thetas), whole, rtol=1e-12, atol=1e-14)


def test_walks_equal_plain_ones(spark):
    rng = np.random.default_rng(5)
    trees = {d: [(f"n{k}", f"n{rng.integers(k)}") for k in range(1, 2 + 3 * d)] for d in range(8)}
    rows = [(d, a, b) for d, links in trees.items() for a, b in links] + [(d, "n0", None) for d in trees]
    rows += [(20, "x", "x"), (21, None, None)] + [(30 + d, a, b) for d, a, b in rows]
    df = spark.createDataFrame(rows, "doc_id int, node string, parent string").repartition(3)
    got = {r.doc_id: r.vec for r in graphs.feather(df, [], order=3, points=4).collect()}
    thetas = [2.5 * (k + 1) / 4 for k in range(4)]
    for d, links in trees.items():
        assert got[d] == pytest.approx(walked(links, 3, thetas)) and got[30 + d] == got[d]
    assert got[20] == got[21] == [0.0] * 24


def test_lost_matches_with_text_ids(spark):
    texts = {"a": "x x x y", "b": "x y y", "c": "x x x z", "d": "", "e": "w"}
    df = spark.createDataFrame([("g", i, t.split()) for i, t in texts.items()], "_k0 string, id string, _toks array<string>")
    grams = lexical.occurrences(df, ["_k0"], "id", 2)
    assert grams.where(F.col("n") == 1).count() == 12
    lost = {r.id: (r.lost_1, r.lost_2) for r in lexical.lost_matches(grams, ["_k0"], "id", 2).collect()}
    # x: 3 and 3, nobody loses; y: b has one more than a; z, w and most pairs have one owner.
    assert lost == {"b": (1, 1), "c": (1, 1), "e": (1, 0)}
