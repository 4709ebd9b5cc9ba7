"""Similarity matrices from pairs of blocks: one matrix product each, odd vectors included."""

import math

import pytest

from effnum.operators import vectors


@pytest.mark.parametrize("metric", ["cosine", "l2sq", "l1"])
def test_odd_vectors(spark, metric):
    rows = [(0, i, [float(i), 1.0]) for i in range(7)] + [(0, 7, None), (0, 8, [1.0, None]), (0, 9, [1.0]), (0, 10, [0.0, 0.0]), (0, None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "g int, id int, vec array<double>")
    out = vectors.pairs(df, ["g"], height=3, metric=metric)
    # No pair is a row before it is scored.
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.i, r.j): r.sim for r in out.collect()}
    vecs = {i: v for _, i, v in rows}
    assert len(found) == len(rows) ** 2
    for (i, j), sim in found.items():
        a, b = vecs[i], vecs[j]
        if i == j and i is not None:
            want = 1.0
        elif a is None or b is None or len(a) != len(b) or None in a or None in b:
            want = None
        elif metric == "cosine":
            want = sum(x * y for x, y in zip(a, b)) / ((math.hypot(*a) or 1) * (math.hypot(*b) or 1))
        else:
            want = sum(abs(x - y) ** (2 if metric == "l2sq" else 1) for x, y in zip(a, b))
        assert sim == want if want is None else abs(sim - want) < 1e-9
