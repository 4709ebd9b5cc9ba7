"""Sums over all pairs of blocks of a group, scheduled in tiles, with pairs ruled out by balls.

The blocks of a group are dealt into g parts, and a task gets two parts: a block is
shuffled once per part, not once per other block, and all pairs of blocks of the two
parts meet inside the task. g follows the bytes of the group (a part must fit a task
twice) and the parallelism wanted, so shuffled bytes grow with g.

Before two blocks are compared their summaries are: a ball (centre and radius in the
metric of the rows) bounds the distance of any two rows from both sides, hence their
similarity. A pair that can add nothing is skipped: either every similarity in it is
clipped to zero, or the largest possible one is below the rounding of the smallest
weight. To make balls small, rows are ordered by a tree grown on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, partitions
from . import blocks as bl
from .ordinals import ordinal

PART_BLOCKS = 32  # blocks of a part: with blocks of two megabytes a task holds some 128 MB
SAMPLE = 8192  # rows on which the order of rows is learned
LEAF = 8  # sampled rows of a leaf
PAIRS = 8  # pairs of blocks handed to a kernel at a time
MERGED = 1024  # rows of the blocks that one block meets at once
COUNTS = -1  # number of the row that counts pairs instead of summing them
MET = -2  # from here downwards, numbers of several blocks handed over as one
LEAST = 1e-16  # share of a weight that its sum cannot hold any more

# Ruled out pairs of blocks: rows of the first table (down) with rows of the second (across).
Skip = Callable[[pa.Table, pa.Table], np.ndarray]


def parts_of(n_blk: Column, tasks: int) -> Column:
    """How many parts a group of ``n_blk`` blocks is dealt into."""
    spread = F.lit(max(1, int(np.sqrt(2 * tasks))))
    return F.least(n_blk, F.greatest(F.ceil(n_blk / F.lit(PART_BLOCKS)), spread)).cast("int")


def tile_sums(
    blocks: DataFrame,
    keys: Sequence[str],
    left: dict[str, Column],
    right: dict[str, Column],
    cross,
    skip: Skip | None = None,
    extra: Sequence[str] = (),
    counts: bool = False,
) -> DataFrame:
    """``keys..., blk, sums`` over every unordered pair of different blocks of a group.

    ``cross`` is a kernel for batches with the columns ``i, j`` (numbers of two blocks) and those that
    ``left`` and ``right`` name; what ``right`` names are lists with an item per row. ``skip`` sees the columns ``extra`` of the blocks. With ``counts``, the row of block
    ``COUNTS`` holds the number of pairs and of skipped ones.
    """
    names, first, second = list(keys), list(left), list(right)
    # Both sides usually carry the same values under two names: each is shuffled once.
    held = {repr(c): c for c in [*left.values(), *right.values()]}
    source = {n: f"_c{list(held).index(repr(c))}" for n, c in [*left.items(), *right.items()]}
    slim = blocks.where(F.col("n_blk") > 1).select(
        *names, "blk", "n_blk", *extra, *[c.alias(f"_c{k}") for k, c in enumerate(held.values())]
    )
    g = parts_of(F.col("n_blk"), partitions(blocks))
    part = F.floor(F.col("blk") * F.col("_g") / F.col("n_blk")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
    dealt = (
        slim.withColumn("_g", g)
        .withColumn("_part", part)
        .withColumn("_other", other)
        .withColumn("_ta", F.least("_part", "_other"))
        .withColumn("_tb", F.greatest("_part", "_other"))
        .drop("_g", "_other", "n_blk")
    )
    schema = T.StructType(
        [*bl.key_fields(blocks, keys), T.StructField("blk", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))]
    )

    def lengths(column: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([np.diff(c.offsets.to_numpy()) for c in column.chunks]).astype(np.int64)

    def joined(column: pa.ChunkedArray, bounds: np.ndarray) -> pa.ListArray:
        """The lists from each bound to the next as one list."""
        lists = pa.concat_arrays(column.chunks)
        return pa.ListArray.from_arrays(lists.offsets.take(pa.array(bounds)), lists.values)

    def add(sums: dict[int, np.ndarray], n: int, v: np.ndarray) -> None:
        sums[n] = sums[n] + v if n in sums else np.asarray(v, np.float64)

    def tile(table: pa.Table) -> pa.Table:
        table = table.sort_by("blk").combine_chunks()
        blk = table.column("blk").to_numpy()
        where = table.column("_part").to_numpy()
        a, b = table.column("_ta")[0].as_py(), table.column("_tb")[0].as_py()
        down, across = np.flatnonzero(where == a), np.flatnonzero(where == b)
        open_ = blk[down][:, None] < blk[across][None, :] if a == b else np.ones((len(down), len(across)), bool)
        total = int(open_.sum())
        if skip is not None and total:
            open_ &= ~skip(table.take(pa.array(down)), table.take(pa.array(across)))
        x, y = np.nonzero(open_)
        x, y = down[x], across[y]
        sums: dict[int, np.ndarray] = {COUNTS: np.array([total, total - len(x)], np.float64)} if counts else {}
        # Of the blocks that one block meets, some are handed over as one: small blocks cost no call a pair.
        rows = lengths(table.column(source[second[0]])) if second else np.full(table.num_rows, MERGED)
        new = np.r_[True, x[1:] != x[:-1]][: len(x)]
        before = np.cumsum(rows[y]) - rows[y]
        lot = (before - np.maximum.accumulate(np.where(new, before, 0))) // MERGED
        first_of = np.flatnonzero(new | np.r_[True, lot[1:] != lot[:-1]][: len(x)])
        for lo in range(0, len(first_of), PAIRS):
            ends = np.append(first_of, len(x))[lo : lo + PAIRS + 1]
            i, met = pa.array(x[ends[:-1]]), y[ends[0] : ends[-1]]
            columns = [table.column("blk").take(i), pa.array(MET - np.arange(len(i)), pa.int32())]
            columns += [table.column(source[n]).take(i) for n in first]
            columns += [joined(table.column(source[n]).take(pa.array(met)), ends - ends[0]) for n in second]
            pairs = pa.table(columns, ["i", "j", *first, *second]).combine_chunks()
            for batch in pairs.to_batches():
                _, found, arrays = cross(batch)
                for n, v in zip(found, arrays):
                    if n > MET:
                        add(sums, n, v)
                        continue
                    own = y[ends[MET - n] : ends[MET - n + 1]]
                    width = len(v) // int(rows[own].sum())  # numbers a row
                    for k, part in zip(own, np.split(v, width * np.cumsum(rows[own])[:-1])):
                        add(sums, int(blk[k]), part)
        out = list(sums)
        keyed = table.select(names).take(pa.array(np.zeros(len(out), np.int64)))
        values = pa.array([sums[n] for n in out], pa.list_(pa.float64()))
        return pa.table([*keyed.columns, pa.array(out, pa.int32()), values], [*names, "blk", "sums"])

    return dealt.groupBy(*names, "_ta", "_tb").applyInArrow(tile, schema)


# --- balls ---


def distance(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """The metric behind a raw score, row by row: angles, Euclidean, city-block or maximum distance."""
    if metric == "cosine":
        return np.arccos(np.clip((x * y).sum(-1), -1.0, 1.0))
    gap = np.abs(x - y)
    if metric == "l2sq":
        return np.sqrt((gap * gap).sum(-1))
    return gap.sum(-1) if metric == "l1" else gap.max(-1)


def ball(x: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Centre and radius of the rows of a block."""
    centre = x.mean(0)
    if metric == "cosine":
        length = np.sqrt(centre @ centre)
        # A zero vector has no direction: such a block is never ruled out.
        if not length > 1e-12 or np.abs((x * x).sum(1) - 1).max() > 1e-6:
            return centre, np.inf
        centre = centre / length
    return centre, float(distance(x, centre[None, :], metric).max())


def similarity_range(low: np.ndarray, high: np.ndarray, metric: str, postprocess: str | None, power: bool):
    """Smallest and largest similarity of two rows whose distance lies between ``low`` and ``high``."""
    if metric == "cosine":
        a, b = np.cos(np.minimum(high, np.pi)), np.cos(np.minimum(low, np.pi))
    elif metric == "l2sq":
        a, b = low**2, high**2
    else:
        a, b = low, high
    if postprocess == "exp":
        a, b = np.exp(-b), np.exp(-a)
    elif postprocess == "invert":
        a, b = 1 - b, 1 - a
    if power:
        top = np.maximum(a * a, b * b)
        a, b = np.where((a < 0) & (b > 0), 0.0, np.minimum(a * a, b * b)), top
    return a, b


def ruled_out(metric: str, postprocess: str | None, power: bool) -> Skip:
    """Pairs of balls that add nothing. Blocks have ``centre, radius, lightest`` and, if clipped, ``mu``."""

    def skip(down: pa.Table, across: pa.Table) -> np.ndarray:
        def side(t):
            centre = np.array(t.column("centre").to_pylist(), np.float64)
            return centre, t.column("radius").to_numpy(), t.column("lightest").to_numpy()

        (c1, r1, w1), (c2, r2, w2) = side(down), side(across)
        apart = np.stack([distance(c[None, :], c2, metric) for c in c1])
        reach = r1[:, None] + r2[None, :]
        slack = 1e-9 * (1 + apart)  # roundings of the centres
        low, high = np.maximum(apart - reach - slack, 0.0), apart + reach + slack
        low = np.where(np.isfinite(reach), low, 0.0)
        least, most = similarity_range(low, high, metric, postprocess, power)
        if "mu" in down.column_names:
            mu = down.column("mu")[0].as_py()
            if mu is not None and mu == mu:
                return np.isfinite(reach) & (most <= mu - 1e-9)
        light = np.minimum(w1[:, None], w2[None, :])
        return np.isfinite(reach) & (np.maximum(np.abs(least), np.abs(most)) <= LEAST * light)

    return skip


def grow(x: np.ndarray, seed: int = 5) -> tuple:
    """A tree over sampled rows: halves along the line between two rows far from each other; leaves in order."""
    rng = np.random.default_rng(seed)
    normals, cuts, children = [], [], []
    leaves = 0

    def down(rows, depth):
        nonlocal leaves
        if len(rows) > LEAF and depth < 40:
            a = x[rng.choice(rows)]
            b = x[rows[((x[rows] - a) ** 2).sum(1).argmax()]]
            a = x[rows[((x[rows] - b) ** 2).sum(1).argmax()]]
            w = b - a
            side = x[rows] @ w
            cut = np.median(side)
            less = side <= cut
            if less.any() and not less.all():
                me = len(children)
                normals.append(w)
                cuts.append(cut)
                children.append(None)
                children[me] = (down(rows[less], depth + 1), down(rows[~less], depth + 1))
                return me
        leaves += 1
        return -leaves

    root = down(np.arange(len(x)), 0)
    return np.array(normals).reshape(-1, x.shape[1]), np.array(cuts), children, root


def leaf_of(tree: tuple, x: np.ndarray) -> np.ndarray:
    normals, cuts, children, root = tree
    out = np.zeros(len(x), np.int32)
    stack = [(root, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        if node < 0:
            out[rows] = -node - 1
        elif len(rows):
            less = x[rows] @ normals[node] <= cuts[node]
            stack += [(children[node][0], rows[less]), (children[node][1], rows[~less])]
    return out


def pack_balls(df: DataFrame, keys: Sequence[str], id: str, vec: str, weight: str, height: int, metric: str) -> DataFrame:
    """Rows in blocks of neighbours: ``keys..., blk, n_blk, n, rows, centre, radius, lightest``.

    Rows follow the leaves of a tree grown on at most twice ``SAMPLE`` rows of the whole table; every
    row is in a block. Rows whose vectors have another length than most are put last, as they are.
    """
    share = df.agg(F.count("*").alias("n"), F.mode(F.size(vec)).alias("dim")).first()
    cut = int(min(1.0, SAMPLE / max(1, share["n"])) * (1 << 30))
    drawn = df.where((F.size(vec) == (share["dim"] or 0)) & (F.pmod(F.xxhash64(id, F.lit(3)), F.lit(1 << 30)) <= cut)).select(vec).limit(2 * SAMPLE)
    sample = np.array([r[0] for r in drawn.collect()], np.float64)
    tree = grow(np.unique(sample, axis=0)) if len(sample) else None
    dim = share["dim"]

    @F.arrow_udf("int")
    def leaf(column: pa.Array) -> pa.Array:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        out = np.full(len(column), np.iinfo(np.int32).max, np.int32)
        at = np.flatnonzero(sizes == dim)
        if len(at) and tree is not None:
            x = np.asarray(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(at), -1)
            out[at] = leaf_of(tree, x)
        return pa.array(out)

    placed = ordinal(df.select(*keys, id, vec, weight).withColumn("_leaf", leaf(F.col(vec))), keys, ["_leaf", id], "_pos")
    placed = cut_lineage(placed.withColumn("blk", F.floor(F.col("_pos") / F.lit(height)).cast("int")).drop("_pos", "_leaf"))
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("blk") + 1).alias("n_blk"))
    gathered = (
        placed.join(sizes, list(keys))
        .repartition(partitions(df), *keys, "blk")
        .groupBy(*keys, "blk", "n_blk", "n")
        .agg(F.array_sort(F.collect_list(F.struct(id, vec, weight))).alias("rows"), F.min(weight).alias("lightest"))
    )

    @F.arrow_udf("struct<centre: array<double>, radius: double>")
    def around(column: pa.Array) -> pa.Array:
        balls = [ball(bl.matrix(column, r), metric) for r in range(len(column))]
        return pa.StructArray.from_arrays(
            [pa.array([c.tolist() for c, _ in balls], pa.list_(pa.float64())), pa.array([r for _, r in balls], pa.float64())], ["centre", "radius"]
        )

    return gathered.withColumn("_ball", around(F.col(f"rows.{vec}"))).select(
        *keys, "blk", "n_blk", "n", "rows", "lightest", F.col("_ball.centre").alias("centre"), F.col("_ball.radius").alias("radius")
    )
