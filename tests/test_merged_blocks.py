"""Many small blocks meet in few calls of a kernel, with the sums of one call a pair."""

import numpy as np
from pyspark.sql import functions as F

from effnum.operators import blocks, tiles, vectors


def test_small_blocks_are_handed_over_together(spark):
    rows = [("a", k, [float(x) for x in np.random.default_rng(k).normal(size=3)], 1.0) for k in range(61)]
    df = spark.createDataFrame(rows, "g string, sid int, x array<double>, p double")
    packed = blocks.pack(df, ["g"], "sid", ["x", "p"], 4).cache()
    n = packed.first()["n_blk"]

    def cross(batch):
        rows, blk, arrays = [], [], []
        for r in range(batch.num_rows):
            x, y = blocks.matrix(batch.column("x"), r), blocks.matrix(batch.column("y"), r)
            z = vectors._scores(x, y, "l1")
            rows += [r, r, r]
            blk += [batch.column("i")[r].as_py(), batch.column("j")[r].as_py(), tiles.COUNTS]
            arrays += [z.sum(1), z.sum(0), np.ones(1)]
        return rows, blk, arrays

    x = F.col("rows.x")
    found = blocks.add_up(tiles.tile_sums(packed, ["g"], {"x": x}, {"y": x}, cross), ["g", "blk"]).collect()
    sums = {r.blk: r.sums for r in found}
    assert sums.pop(tiles.COUNTS)[0] < n * (n - 1) / 4  # calls: fewer than half the pairs
    held = {r.blk: np.array([e.x for e in r.rows]) for r in packed.collect()}
    assert set(sums) == set(held)
    for k, v in sums.items():
        others = np.concatenate([m for b, m in held.items() if b != k])
        assert np.allclose(v, np.abs(held[k][:, None] - others[None]).sum((1, 2)))


def test_scores_in_place_are_the_same(monkeypatch):
    monkeypatch.setattr(vectors, "NUMBERS", 50)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(23, 5)), rng.normal(size=(17, 5))
    gaps = np.abs(a[:, None] - b[None])
    assert np.allclose(vectors._scores(a, b, "l1"), gaps.sum(2))
    assert np.array_equal(vectors._scores(a, b, "linf"), gaps.max(2))


def test_selection_moves_blocks_in_tiles(spark, monkeypatch, tiny_blocks):
    """The exact choice over several blocks is that of one task, and no block is joined with every other one."""
    from effnum.operators import selection

    rng = np.random.default_rng(8)
    rows = [(g, k, rng.normal(size=3).tolist()) for g in "ab" for k in range(40)]
    df = spark.createDataFrame(rows, "g string, id int, vec array<double>")
    want = {m: selection.select_diverse(df, 4, m, by=["g"]).collect() for m in ("facility_location", "balanced")}

    def never(*_):
        raise AssertionError("pairs of blocks were joined one by one")

    monkeypatch.setattr(selection, "GROUP_ROWS", 8)
    monkeypatch.setattr(blocks, "block_pairs", never)
    for method, rows in want.items():
        got = selection.select_diverse(df, 4, method, by=["g"]).collect()
        assert sorted((r.g, r.rank, r.id) for r in got) == sorted((r.g, r.rank, r.id) for r in rows)
