import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from effnum.operators import custom, hill, vectors


def hill_number(z, p, q=1.0):
    zp = z @ p
    if q == 1:
        return math.exp(-(p * np.log(zp + 1e-10)).sum())
    if math.isinf(q):
        return 1 / zp.max()
    return ((p * zp ** (q - 1)).sum()) ** (1 / (1 - q))


def test_identity_similarity_counts_species(spark):
    df = spark.createDataFrame([("g", 1 / 3, 1 / 3)] * 3, "g string, p double, zp double")
    for q in (0.0, 1.0, 2.0, math.inf):
        row = hill.diversity(df, ["g"], q).first()
        assert row.diversity == pytest.approx(3.0, abs=1e-6) and row.saturated and row.status == "ok"
        assert hill.diversity(df, ["g"], q, normalize=True).first().diversity == pytest.approx(1.0, abs=1e-6)


def test_statuses(spark):
    rows = [
        ("ok", 0.5, 0.6, True),
        ("ok", 0.5, 0.7, True),
        ("invalid", 0.5, 0.6, True),
        ("invalid", None, None, False),
        ("empty", None, None, True),
        ("nan", 1.0, float("nan"), True),
        ("zero", 0.5, 0.0, True),
        ("zero", 0.5, 0.0, True),
        ("undefined", 0.5, -0.2, True),
        ("undefined", 0.5, 0.9, True),
    ]
    df = spark.createDataFrame(rows, "g string, p double, zp double, valid boolean")
    got = {r.g: r for r in hill.diversity(df, ["g"]).collect()}
    assert {g: r.status for g, r in got.items()} == {
        "ok": "ok",
        "invalid": "invalid",
        "empty": "empty",
        "nan": "nan_similarity",
        "zero": "zero_similarity",
        "undefined": "undefined",
    }
    assert got["invalid"].diversity == 0.0 and got["empty"].diversity == 0.0 and got["nan"].diversity == 1.0
    assert got["zero"].diversity == 2.0 and got["undefined"].diversity == 2.0
    two = {r.g: r for r in hill.diversity(df, ["g"], q=2.0).collect()}
    assert two["undefined"].status == "negative_zp"
    assert two["undefined"].diversity == pytest.approx(1 / (0.5 * -0.2 + 0.5 * 0.9))


def similarity(x, metric, post, power, adjust):
    n = len(x)
    if metric == "cosine":
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.where(norm == 0, 1, norm)
        z = u @ u.T
    else:
        gaps = np.abs(x[:, None, :] - x[None, :, :])
        z = {"l2sq": (gaps**2).sum(2), "l1": gaps.sum(2), "linf": gaps.max(2)}[metric]
    z = np.exp(-z) if post == "exp" else 1 - z if post == "invert" else z
    np.fill_diagonal(z, 1.0)
    z = z**2 if power else z
    off = ~np.eye(n, dtype=bool)
    if adjust and n > 1:
        z[off] -= z[off].mean()
        z = np.maximum(z, 0)
    return z


CASES = [
    ("cosine", None, False, False),
    ("cosine", None, True, False),
    ("cosine", "invert", False, False),
    ("cosine", "invert", True, False),
    ("cosine", "exp", False, False),
    ("cosine", None, True, True),
    ("cosine", None, False, True),
    ("l2sq", None, False, False),
    ("l2sq", "exp", False, True),
    ("l1", "exp", False, False),
    ("linf", "exp", True, False),
]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows, groups = [], {"many": 23, "even": 16, "few": 3, "one": 1}
    for g, n in groups.items():
        x = np.abs(rng.normal(size=(n, 5)))
        if n > 3:
            x[1] = 0.0
            x[2] = x[3]
        rows += [(g, i, [float(v) for v in r], float(1 + i % 3)) for i, r in enumerate(x)]
    return rows, spark.createDataFrame(rows, "g string, id long, vec array<double>, w double").cache()


@pytest.mark.parametrize("case", CASES, ids=str)
@pytest.mark.parametrize("weight", [None, "w"])
def test_every_route_equals_the_matrix(points, case, weight, tiny_blocks):
    rows, df = points
    metric, post, power, adjust = case
    mass = vectors.similarity_mass(
        df, ["g"], "id", "vec", metric=metric, postprocess=post, power=power, mean_adjust=adjust, weight=weight
    )
    got = {(r.g, r.id): (r.p, r.zp) for r in mass.collect()}
    for g in ("many", "even", "few", "one"):
        mine = [r for r in rows if r[0] == g]
        p = np.array([r[3] if weight else 1.0 for r in mine])
        p = p / p.sum()
        zp = similarity(np.array([r[2] for r in mine]), metric, post, power, adjust) @ p
        for i, r in enumerate(mine):
            assert got[(g, r[1])] == pytest.approx((p[i], zp[i]), abs=1e-9), (g, i)


def test_hot_group_is_split_and_whole(spark, tiny_blocks):
    """A third of all rows in one group: nothing is lost, and no block outgrows its size."""
    from effnum.operators import blocks as bl

    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", i, [float(v) for v in rng.normal(size=3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id long, vec array<double>")
    out = {r.g: r for r in vectors.document_diversity(df, ["g"], power=True).collect()}
    x = np.array([r[2] for r in rows if r[0] == "hot"])
    want = hill_number(similarity(x, "cosine", None, True, False), np.full(len(x), 1 / len(x)))
    assert out["hot"].n_species == 200 and out["hot"].diversity == pytest.approx(want)
    assert sum(r.n_species for r in out.values()) == 600
    packed = bl.pack(df.withColumn("x", F.col("vec")), ["g"], "id", ["x"], 4)
    assert packed.agg(F.max(F.size("rows"))).first()[0] <= 20


def test_whole_table_without_keys(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, vec array<double>")
    out = vectors.document_diversity(df, [])
    assert out.columns[0] == "metric" and out.first().n_species == 3
    assert vectors.mean_cosine(df).first().mean_cosine == pytest.approx(1 / 3)
    assert vectors.mean_similarity(df).first().similarity == pytest.approx(5 / 9)


def test_invalid_text_makes_group_zero(spark):
    df = spark.createDataFrame(
        [("a", 1, "fine", [1.0]), ("a", 2, "  ", [1.0]), ("b", 1, "x", [1.0]), ("c", 1, "x", None)],
        "g string, id long, text string, vec array<double>",
    )
    for power in (False, True):
        got = {r.g: (r.status, r.diversity) for r in vectors.document_diversity(df, ["g"], text="text", power=power).collect()}
        assert got["a"] == ("invalid", 0.0) and got["b"][0] == "ok" and got["c"] == ("empty", 0.0)


def test_pairs_hold_both_halves_and_diagonal(points, spark):
    rows, df = points
    got = {(r.g, r.i, r.j): r.sim for r in vectors.pairs(df, ["g"], height=4).collect()}
    assert len(got) == 23**2 + 16**2 + 9 + 1
    x = np.array([r[2] for r in rows if r[0] == "even"])
    z = similarity(x, "cosine", None, False, False)
    assert all(got[("even", i, j)] == pytest.approx(z[i, j], abs=1e-9) for i in range(16) for j in range(16))


def test_custom_metric(spark):
    df = spark.createDataFrame([("g", i, i % 4) for i in range(10)], "g string, id long, v int")

    def near(a, b):
        return (np.array(a)[:, None] == np.array(b)[None, :]).astype(float)

    for height in (3, 100):
        out = custom.hill_custom(df, ["g"], "id", "v", near, q=0.0, height=height).first()
        assert out.diversity == pytest.approx(4.0)


def test_unknown_settings_are_errors(spark):
    df = spark.createDataFrame([(1, [1.0])], "id long, vec array<double>")
    with pytest.raises(ValueError):
        vectors.document_diversity(df, [], metric="nope")
    with pytest.raises(ValueError):
        vectors.document_diversity(df, [], postprocess="nope")


def test_pca_matches_svd(spark):
    from effnum.operators.reduce import pca

    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4)) * [5, 2, 1, 0.1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = np.array([r.pca for r in pca(df, [], n_components=2).orderBy("id").collect()])
    _, s, vt = np.linalg.svd(x - x.mean(0))
    want = (x - x.mean(0)) @ vt[:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    assert len(pca(df, [], n_components=9).first().pca) == 4


def test_no_cross_join_without_keys(spark):
    from effnum.operators import evaluate

    df = spark.createDataFrame([(i, [float(i), 1.0], float(i)) for i in range(5)], "id long, vec array<double>, x double")
    frames = [vectors.similarity_mass(df, []), evaluate.max_scaled(df.select("id", "x"), ["x"])]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
