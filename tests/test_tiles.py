"""Tiles of blocks and pairs ruled out by balls: the same sums, fewer comparisons, fewer copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from effnum.operators import blocks as bl
from effnum.operators import custom, tiles, vectors


def frame(spark, x, group="g"):
    rows = [(group, i, [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "g string, id long, vec array<double>").repartition(4)


def clustered(n=240, d=6, far=50.0, spread=0.3, seed=1, k=8):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(k, d))[rng.integers(0, k, n)] * far + rng.normal(size=(n, d)) * spread


def brute(x, metric, post, power, adjust, w=None):
    x = x / np.sqrt((x * x).sum(1))[:, None] if metric == "cosine" else x
    z = vectors._similarity(x, x, metric, post, power)
    n = len(x)
    p = np.full(n, 1 / n) if w is None else w / w.sum()
    if adjust:
        mu = (z.sum() - np.trace(z)) / (n * (n - 1))
        z = np.maximum(z - mu, 0)
    np.fill_diagonal(z, 1)
    return z @ p


ROUTES = [("l1", "exp", False, False), ("linf", "exp", False, False), ("l2sq", "exp", True, False), ("l1", None, False, False),
          ("linf", "invert", False, False), ("cosine", None, True, True), ("cosine", None, False, True), ("cosine", "exp", False, False),
          ("l2sq", "exp", False, True)]


@pytest.mark.parametrize("metric,post,power,adjust", ROUTES)
@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_same_sums_as_brute_force(spark, metric, post, power, adjust, kind):
    x = clustered() if kind == "clustered" else np.random.default_rng(2).normal(size=(150, 5))
    df = frame(spark, x)
    options = dict(metric=metric, postprocess=post, power=power, mean_adjust=adjust, height=16)
    got = vectors.similarity_mass(df, ["g"], "id", "vec", **options).orderBy("id").collect()
    want = brute(x, metric, post, power, adjust)
    assert np.allclose([r.zp for r in got], want, rtol=1e-11, atol=1e-13)


def test_weights_and_small_groups_beside_large(spark):
    x = clustered(n=100)
    df = frame(spark, x).union(frame(spark, x[:7], "h")).withColumn("w", F.lit(1.0) + F.col("id") % 3)
    got = vectors.similarity_mass(df, ["g"], "id", "vec", metric="l1", postprocess="exp", weight="w", height=16)
    for g, n in (("g", 100), ("h", 7)):
        rows = got.where(F.col("g") == g).orderBy("id").collect()
        want = brute(x[:n], "l1", "exp", False, False, 1.0 + np.arange(n) % 3)
        assert np.allclose([r.zp for r in rows], want, rtol=1e-11)


def test_far_clusters_are_skipped(spark):
    count = lambda x, *a, **o: vectors.pair_counts(frame(spark, x), ["g"], "id", "vec", *a, height=10, **o).first()
    # Four clusters of a hundred rows: a few blocks lie across two of them.
    near = count(clustered(400, k=4), "l1", "exp")
    assert near.n_pairs == 40 * 39 / 2 and near.n_skipped > 0.5 * near.n_pairs
    assert count(np.random.default_rng(3).normal(size=(400, 6)), "l1", "exp").n_skipped == 0
    # Similarities that are clipped anyway: angles above the level.
    clipped = count(clustered(400, k=4), "cosine", None, False, mu=0.9)
    assert clipped.n_skipped > 0.4 * clipped.n_pairs


@pytest.mark.parametrize("metric", ["cosine", "l2sq", "l1", "linf"])
@pytest.mark.parametrize("post", [None, "exp", "invert"])
@pytest.mark.parametrize("power", [False, True])
def test_bounds_hold(metric, post, power):
    rng = np.random.default_rng(4)
    for scale in (0.1, 1.0, 5.0):
        a, b = (rng.normal(size=(12, 4)) * 0.2 + rng.normal(size=4) * scale for _ in range(2))
        if metric == "cosine":
            a, b = (v / np.sqrt((v * v).sum(1))[:, None] for v in (a, b))
        (c1, r1), (c2, r2) = tiles.ball(a, metric), tiles.ball(b, metric)
        apart = tiles.distance(c1, c2, metric)
        low, high = tiles.similarity_range(np.maximum(apart - r1 - r2, 0), apart + r1 + r2, metric, post, power)
        z = vectors._similarity(a, b, metric, post, power)
        assert low - 1e-9 <= z.min() and z.max() <= high + 1e-9


def test_zero_vectors_are_never_ruled_out(spark):
    x = np.vstack([clustered(n=60), np.zeros((4, 6))])
    got = vectors.similarity_mass(frame(spark, x), ["g"], "id", "vec", power=True, mean_adjust=True, height=8).orderBy("id").collect()
    unit = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
    z = (unit @ unit.T) ** 2
    mu = (z.sum() - np.trace(z)) / (len(x) * (len(x) - 1))
    z = np.maximum(z - mu, 0)
    np.fill_diagonal(z, 1)
    assert np.allclose([r.zp for r in got], z.mean(1), rtol=1e-9)


def test_shuffled_copies_follow_parts_not_blocks(spark):
    """A block goes to g tasks. With pairs of blocks it went to as many as the group has blocks."""
    df = frame(spark, np.random.default_rng(6).normal(size=(640, 3)))
    rows = df.select("g", F.col("id").alias("sid"), F.col("vec").alias("x"), F.lit(1.0).alias("p"))
    for height in (10, 20, 40):
        blocks = bl.pack(rows, ["g"], "sid", ["x", "p"], height)
        n_blk = 640 // height
        g = tiles.parts_of(F.col("n_blk"), int(spark.conf.get("spark.sql.shuffle.partitions")))
        assert blocks.select(g.alias("g")).first().g == 2 < n_blk / 2
    many = spark.createDataFrame([(n,) for n in (1, 2, 63, 64, 65, 1000)], "n_blk int")
    assert [r[0] for r in many.select(tiles.parts_of(F.col("n_blk"), 2)).collect()] == [1, 2, 2, 2, 3, 32]


def test_custom_similarity_with_bound(spark):
    x = np.concatenate([np.arange(40) * 0.01 + c * 100 for c in range(4)])
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "g int, id long, x double")
    seen = spark.sparkContext.accumulator(0)

    def near(a, b):
        seen.add(1)
        return np.exp(-np.abs(np.array(a)[:, None] - np.array(b)[None, :]))

    def upper(a, b):
        gap = max(a[0] - b[1], b[0] - a[1], 0.0)
        return float(np.exp(-gap))

    plain = custom.similarity_mass(df, ["g"], "id", "x", near, height=20).orderBy("id").collect()
    all_calls = seen.value
    bound = custom.similarity_mass(df, ["g"], "id", "x", near, height=20, near="x", summary=lambda f: (min(f), max(f)), upper=upper)
    bound = bound.orderBy("id").collect()
    assert np.allclose([r.zp for r in plain], [r.zp for r in bound], rtol=1e-12)
    assert seen.value - all_calls < all_calls
