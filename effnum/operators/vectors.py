"""Diversity of vector-valued species.

Three routes to ``(Zp)_i``, chosen by the kernel and never by the data:

* similarities linear in the inner product (plain and inverted cosine, squared
  Euclidean distance): one weighted mean vector per group, all inside the JVM,
* similarities quadratic in it (squared cosine): one d x d second moment per
  group, applied block by block,
* everything else (exponential, city-block, maximum distance, clipping after
  mean adjustment): sums over pairs of blocks of neighbours, in tiles, without the
  pairs of blocks that can add nothing (``tiles``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import vector as vx
from ..session import cut_lineage, keyed, unkeyed
from . import blocks as bl
from . import hill, tiles

METRICS = ("cosine", "l2sq", "l1", "linf")
POSTPROCESS = (None, "exp", "invert")


def _check(metric: str, postprocess: str | None) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")
    if postprocess not in POSTPROCESS:
        raise ValueError(f"unknown postprocess {postprocess!r}, expected one of {POSTPROCESS}")


def _polynomial(postprocess: str | None, power: bool) -> tuple[float, float, float] | None:
    """Coefficients of the similarity as a polynomial of the raw score."""
    if postprocess == "exp":
        return None
    base = (1.0, -1.0) if postprocess == "invert" else (0.0, 1.0)
    if not power:
        return (base[0], base[1], 0.0)
    return (base[0] ** 2, 2 * base[0] * base[1], base[1] ** 2)


def _species(df: DataFrame, keys: list[str], id: str, vec: str, weight: str | None, metric: str) -> DataFrame:
    """``keys..., sid, x, w``; cosine rows at length one. Rows without a vector are
    no species."""
    x = F.col(vec).cast("array<double>")
    return df.where(F.col(vec).isNotNull()).select(
        *keys,
        F.col(id).alias("sid"),
        (vx.unit(x) if metric == "cosine" else x).alias("x"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    )


def similarity_mass(
    df: DataFrame,
    by: Sequence[str] = (),
    id: str = "id",
    vec: str = "vec",
    metric: str = "cosine",
    postprocess: str | None = None,
    power: bool = False,
    mean_adjust: bool = False,
    weight: str | None = None,
    text: str | None = None,
    dim: int | None = None,
    height: int | None = None,
) -> DataFrame:
    """``by..., id, p, zp, valid``: what the Hill aggregate needs, one row per species.

    With ``text``, every group has one more row that says whether all its texts are
    usable; it has no ``p`` and ``zp`` and is no species. ``dim`` only sizes the
    blocks (or ``height``, in rows); leave it out to assume a few hundred.
    """
    _check(metric, postprocess)
    src, keys = keyed(df, by)
    species = _species(src, keys, id, vec, weight, metric)
    poly = _polynomial(postprocess, power)
    linear = poly is not None and poly[2] == 0 and metric in ("cosine", "l2sq")
    if linear and not mean_adjust:
        many = bool(by) and src.select(*keys).distinct().limit(FEW_GROUPS + 1).count() > FEW_GROUPS
        out = _linear(species, keys, metric, poly, many)
    else:
        out = _blocked(species, keys, metric, postprocess, power, mean_adjust, poly, dim or 256, height)
    out = out.withColumn("valid", F.lit(True))
    if text:
        nothing = F.lit(None).cast("double")
        flags = src.groupBy(*keys).agg(F.min(tx.non_blank(text)).alias("valid"))
        sid = F.lit(None).cast(out.schema["sid"].dataType)
        out = out.unionByName(flags.select(*keys, sid.alias("sid"), nothing.alias("p"), nothing.alias("zp"), "valid"))
    return unkeyed(by, out.withColumnRenamed("sid", id))


def _linear(species: DataFrame, keys: list[str], metric: str, poly: tuple, many: bool = False) -> DataFrame:
    """From one mean vector per group. The means of ``many`` groups are merged with the rows: vectors
    of few values shrink so much in a shuffle that they would pass for a table small enough to broadcast."""
    c0, c1, _ = poly
    mean = vector_to_array(Summarizer.mean(array_to_vector("x"), F.col("w")))
    moments = species.groupBy(*keys).agg(
        mean.alias("_m"),
        F.sum("w").alias("_w"),
        (F.sum(F.col("w") * vx.squared_norm("x")) / F.sum("w")).alias("_sq"),
    )
    rows = species.join(moments.hint("shuffle_merge") if many else moments, keys)
    p = F.col("w") / F.col("_w")
    s = vx.squared_norm("x")
    product = vx.dot("x", "_m")
    if metric == "cosine":
        rest = product - p * s
    else:
        rest = s + F.col("_sq") - F.lit(2.0) * product
    zp = p + F.lit(c0) * (F.lit(1.0) - p) + F.lit(c1) * rest
    return rows.select(*keys, "sid", p.alias("p"), zp.alias("zp"))


def _scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Raw scores of all rows of ``a`` against all rows of ``b``."""
    if metric == "cosine":
        return a @ b.T
    if metric == "l2sq":
        gaps = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)
        return np.maximum(gaps, 0.0)
    out = np.zeros((len(a), len(b)))
    columns, step = np.ascontiguousarray(b.T), max(1, NUMBERS // max(1, len(b)))
    gather = np.add if metric == "l1" else np.maximum
    for s in range(0, len(a), step):
        # A few rows at a time, in place: the working tables stay in a cache.
        here = out[s : s + step]
        gap = np.empty_like(here)
        for k in range(a.shape[1]):
            np.subtract(a[s : s + step, k][:, None], columns[k], out=gap)
            np.abs(gap, out=gap)
            gather(here, gap, out=here)
    return out


def _similarity(a, b, metric, postprocess, power, mu=None) -> np.ndarray:
    z = _scores(a, b, metric)
    if postprocess == "exp":
        z = np.exp(-z)
    elif postprocess == "invert":
        z = 1.0 - z
    if power:
        z = z * z
    if mu is not None:
        z = np.maximum(z - mu, 0.0)
    return z


FEW_GROUPS = 1024  # groups whose mean vectors may be sent to every executor
FIELDS = ("sid", "p")  # what a packed species carries beside its vector
NUMBERS = 1 << 15  # numbers of a working table that is written again for every dimension
STRIPE = 512  # rows of a block compared at a time, to bound the working matrix


def _within(x, p, metric, postprocess, power, mu) -> np.ndarray:
    """Row sums inside one block, the diagonal at one."""
    out = np.empty(len(x))
    for s in range(0, len(x), STRIPE):
        z = _similarity(x[s : s + STRIPE], x, metric, postprocess, power, mu)
        idx = np.arange(len(z))
        z[idx, s + idx] = 1.0
        out[s : s + STRIPE] = z @ p
    return out


def _across(x, p, y, r, metric, postprocess, power, mu) -> tuple[np.ndarray, np.ndarray]:
    """Row sums of two different blocks over each other."""
    ours, theirs = np.empty(len(x)), np.zeros(len(y))
    for s in range(0, len(x), STRIPE):
        z = _similarity(x[s : s + STRIPE], y, metric, postprocess, power, mu)
        ours[s : s + STRIPE] = z @ r
        theirs += z.T @ p[s : s + STRIPE]
    return ours, theirs


def _pair_sums(blocks: DataFrame, keys: list[str], metric, postprocess, power, weighted: bool, adjusted: bool) -> DataFrame:
    """``keys..., blk, sums`` over all pairs: self pairs from the blocks themselves,
    the others from tiles of blocks, but for those that their balls rule out (when every
    weight counts the same, nothing but exact zeros is). ``weighted`` uses p, otherwise ones."""
    extra = [F.col("mu")] if adjusted else []

    def payload(batch: pa.RecordBatch, row: int, x: str, p: str):
        m = bl.matrix(batch.column(x), row)
        return m, bl.vector(batch.column(p), row) if weighted else np.ones(len(m))

    def level(batch: pa.RecordBatch, row: int):
        if not adjusted:
            return None
        mu = batch.column("mu")[row].as_py()
        return 0.0 if mu is None or mu != mu else mu

    def own(batch: pa.RecordBatch):
        rows, blk, arrays = [], batch.column("blk").to_pylist(), []
        for r in range(batch.num_rows):
            x, p = payload(batch, r, "x", "p")
            arrays.append(_within(x, p, metric, postprocess, power, level(batch, r)))
            rows.append(r)
        return rows, blk, arrays

    def cross(batch: pa.RecordBatch):
        rows, blk, arrays = [], [], []
        left, right = batch.column("i").to_pylist(), batch.column("j").to_pylist()
        for r in range(batch.num_rows):
            x, p = payload(batch, r, "x", "p")
            y, q = payload(batch, r, "y", "q")
            ours, theirs = _across(x, p, y, q, metric, postprocess, power, level(batch, r))
            rows += [r, r]
            blk += [left[r], right[r]]
            arrays += [ours, theirs]
        return rows, blk, arrays

    x, p = F.col("rows.x").alias("x"), F.col("rows.p").alias("p")
    single = bl.run(blocks.select(*keys, "blk", x, p, *extra), keys, own)
    mu = {"mu": F.col("mu")} if adjusted else {}
    balls = ["centre", "radius", "lightest", *mu]
    skip = tiles.ruled_out(metric, postprocess, power) if weighted else None
    sides = {"x": F.col("rows.x"), "p": F.col("rows.p"), **mu}, {"y": F.col("rows.x"), "q": F.col("rows.p")}
    double = tiles.tile_sums(blocks, keys, *sides, cross, skip, balls if weighted else [])
    return bl.add_up(single.unionByName(double), [*keys, "blk"])


def _second_moment(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., m1, m2``: weighted first and second moments of large groups.

    Every block emits the d rows of its second moment; the rows are added up per
    (group, row), so that no single task sums whole matrices of a large group.
    """

    def moments(batch: pa.RecordBatch):
        rows, idx, arrays = [], [], []
        for r in range(batch.num_rows):
            x, p = bl.matrix(batch.column("x"), r), bl.vector(batch.column("p"), r)
            weighted = x * p[:, None]
            gram = np.vstack([weighted.sum(0), x.T @ weighted])
            rows += [r] * len(gram)
            idx += list(range(len(gram)))
            arrays += list(gram)
        return rows, idx, arrays

    x, p = F.col("rows.x").alias("x"), F.col("rows.p").alias("p")
    parts = bl.run(blocks.select(*keys, "blk", x, p), keys, moments)
    lines = bl.add_up(parts, [*keys, "blk"])
    # d + 1 lines per group, put in order.
    ordered = F.array_sort(F.collect_list(F.struct("blk", "sums")))
    return lines.groupBy(*keys).agg(ordered["sums"].alias("_l")).select(
        *keys,
        F.col("_l")[0].alias("m1"),
        F.slice("_l", F.lit(2), F.size("_l") - 1).alias("m2"),
    )


def _blocked(
    species: DataFrame,
    keys: list[str],
    metric: str,
    postprocess: str | None,
    power: bool,
    mean_adjust: bool,
    poly: tuple | None,
    dim: int,
    height: int | None = None,
) -> DataFrame:
    totals = species.groupBy(*keys).agg(F.sum("w").alias("_w"))
    weighted = species.join(totals, keys).withColumn("p", F.col("w") / F.col("_w"))
    height = height or bl.rows_per_block(dim)
    moments = poly is not None and metric == "cosine" and not mean_adjust
    if moments:
        small, large = bl.packed(weighted, keys, "sid", ["x", "p"], height)
    else:
        small, large = _ball_blocks(weighted, keys, metric, height)
    parts = []
    if small is not None:
        parts.append(_whole_groups(small, keys, metric, postprocess, power, mean_adjust))
    if large is not None and moments:
        parts.append(_quadratic(large, keys, poly))
    elif large is not None:
        if mean_adjust:
            mu = _off_diagonal_mean(large, keys, metric, postprocess, power, poly)
            large = large.join(mu, keys, "left")
        sums = _pair_sums(large, keys, metric, postprocess, power, True, mean_adjust)
        parts.append(bl.unpack(large, sums, keys, FIELDS))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(*keys, "sid", "p", F.col("sum").alias("zp"))


def _ball_blocks(weighted: DataFrame, keys: list[str], metric: str, height: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Groups of one block, and the blocks of neighbours of larger ones; either may be ``None``."""
    sizes = cut_lineage(weighted.groupBy(*keys).agg(F.count("*").alias("_c")))
    low, high = sizes.agg(F.min("_c"), F.max("_c")).first()
    parts = weighted.join(sizes, keys)
    small = large = None
    if high is None or low <= height:
        rows = parts.where(F.col("_c") <= height).drop("_c")
        small = cut_lineage(bl.pack(rows, keys, "sid", ["x", "p"], height))
    if high is not None and high > height:
        rows = parts.where(F.col("_c") > height).drop("_c")
        large = cut_lineage(tiles.pack_balls(rows, keys, "sid", "x", "p", height, metric))
    return small, large


def _whole_groups(small: DataFrame, keys: list[str], metric, postprocess, power, mean_adjust) -> DataFrame:
    """Groups of a single block, at most a few thousand rows: everything at once."""

    def dense(batch: pa.RecordBatch) -> list[np.ndarray]:
        arrays = []
        for r in range(batch.num_rows):
            x, p = bl.matrix(batch.column("x"), r), bl.vector(batch.column("p"), r)
            mu, n = None, len(x)
            if mean_adjust and n > 1:
                total = _within(x, np.ones(n), metric, postprocess, power, None).sum()
                mu = (total - n) / (n * (n - 1.0))
            arrays.append(_within(x, p, metric, postprocess, power, mu))
        return arrays

    return bl.run_rows(small, keys, FIELDS, dense, [F.col("rows.x").alias("x")])


def _quadratic(large: DataFrame, keys: list[str], poly: tuple) -> DataFrame:
    """``(Zp)_i`` from the second moment of the group, one matrix product per block."""
    c0, c1, c2 = poly

    def apply(batch: pa.RecordBatch) -> list[np.ndarray]:
        arrays = []
        for r in range(batch.num_rows):
            x, p = bl.matrix(batch.column("x"), r), bl.vector(batch.column("p"), r)
            m1, m2 = bl.vector(batch.column("m1"), r), bl.matrix(batch.column("m2"), r)
            s = (x * x).sum(1)
            square = ((x @ m2) * x).sum(1) - p * s * s
            arrays.append(p + c0 * (1 - p) + c1 * (x @ m1 - p * s) + c2 * square)
        return arrays

    moments = _second_moment(large, keys)
    return bl.run_rows(large.join(moments, keys), keys, FIELDS, apply, [F.col("rows.x").alias("x"), "m1", "m2"])


def _off_diagonal_mean(large: DataFrame, keys: list[str], metric, postprocess, power, poly) -> DataFrame:
    """``keys..., mu``: mean similarity of different species, before clipping.

    For polynomials of the cosine it follows from the moments; otherwise it takes
    one pass over the pairs.
    """
    n = F.col("n").cast("double")
    sizes = large.groupBy(*keys).agg(F.first("n").alias("n"))
    if poly is None or metric != "cosine":
        sums = _pair_sums(large, keys, metric, postprocess, power, False, False)
        totals = sums.groupBy(*keys).agg(
            F.sum(F.aggregate("sums", F.lit(0.0), lambda s, v: s + v)).alias("_t")
        )
        return totals.join(sizes, keys).select(
            *keys, F.try_divide(F.col("_t") - n, n * (n - 1)).alias("mu")
        )
    c0, c1, c2 = poly
    plain = large.withColumn(
        "rows", F.transform("rows", lambda r: F.struct(r["x"].alias("x"), F.lit(1.0).alias("p")))
    )
    selfs = F.transform("rows", lambda r: vx.squared_norm(r["x"]))
    diagonal = large.select(*keys, F.explode(selfs).alias("_s")).groupBy(*keys).agg(
        F.sum("_s").alias("_s1"), F.sum(F.col("_s") * F.col("_s")).alias("_s2")
    )
    frobenius = F.aggregate("m2", F.lit(0.0), lambda s, line: s + vx.squared_norm(line))
    total = (
        F.lit(c0) * n * (n - 1)
        + F.lit(c1) * (vx.squared_norm("m1") - F.col("_s1"))
        + F.lit(c2) * (frobenius - F.col("_s2"))
    )
    return (
        _second_moment(plain, keys)
        .join(diagonal, keys)
        .join(sizes, keys)
        .select(*keys, F.try_divide(total, n * (n - 1)).alias("mu"))
    )


def pair_counts(
    df: DataFrame, by: Sequence[str], id: str, vec: str, metric: str, postprocess: str | None = None,
    power: bool = False, mu: float | None = None, height: int = 1024,
) -> DataFrame:
    """``by..., n_pairs, n_skipped``: pairs of different blocks, and those that their balls rule out.

    ``mu`` is the level below which similarities are clipped, if they are. Nothing is compared.
    """
    src, keys = keyed(df, by)
    species = _species(src, keys, id, vec, None, metric)
    n = species.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = species.join(n, keys).select(*keys, "sid", "x", (F.lit(1.0) / F.col("_n")).alias("p"))
    blocks = tiles.pack_balls(rows, keys, "sid", "x", "p", height, metric)
    level = ["mu"] if mu is not None else []
    if level:
        blocks = blocks.withColumn("mu", F.lit(float(mu)))
    nothing = lambda batch: ([], [], [])
    counted = tiles.tile_sums(blocks, keys, {}, {}, nothing, tiles.ruled_out(metric, postprocess, power), ["centre", "radius", "lightest", *level], counts=True)
    sums = bl.add_up(counted, keys)
    out = sums.select(*keys, *[F.col("sums")[k].cast("bigint").alias(n) for k, n in enumerate(("n_pairs", "n_skipped"))])
    return unkeyed(by, out)


def document_diversity(
    df: DataFrame,
    by: Sequence[str] = (),
    id: str = "id",
    vec: str = "vec",
    q: float = 1.0,
    normalize: bool = False,
    n_components: int | str | None = None,
    metric_name: str = "document_semantics",
    **similarity: object,
) -> DataFrame:
    """Diversity with one species per row of ``df``; plain cosine by default.

    ``similarity`` is passed on to :func:`similarity_mass`.
    """
    if n_components is not None:
        from .reduce import pca

        df, vec = pca(df, by, id, vec, n_components), "pca"
    mass = similarity_mass(df, by, id, vec, **similarity)
    return hill.diversity(mass, by, q, normalize, metric_name)


def mean_similarity(df: DataFrame, by: Sequence[str] = (), id: str = "id", vec: str = "vec", **similarity: object) -> DataFrame:
    """Mean of the similarity matrix per group, diagonal included."""
    return hill.mean_similarity(similarity_mass(df, by, id, vec, **similarity), by)


def mean_cosine(df: DataFrame, by: Sequence[str] = (), vec: str = "vec") -> DataFrame:
    """Mean cosine of different rows per group: ``by..., n, mean_cosine``.

    From the sum of the unit vectors; no pairs. One row gives no value.
    """
    src, keys = keyed(df, by)
    unit = src.select(*keys, vx.unit(F.col(vec).cast("array<double>")).alias("x"))
    sums = unit.groupBy(*keys).agg(
        F.count("*").alias("n"),
        vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("_m"),
        F.sum(vx.squared_norm("x")).alias("_s"),
    )
    n = F.col("n").cast("double")
    value = F.try_divide(vx.squared_norm("_m") - F.col("_s"), n * (n - 1))
    return unkeyed(by, sums.select(*keys, "n", value.alias("mean_cosine")))


def pair_score(a: str | Column, b: str | Column, metric: str, postprocess: str | None, power: bool) -> Column:
    """Similarity of two vector columns, as an expression."""
    _check(metric, postprocess)
    score = {
        "cosine": vx.cosine,
        "l2sq": vx.squared_distance,
        "l1": vx.manhattan,
        "linf": vx.chebyshev,
    }[metric](a, b)
    if postprocess == "exp":
        score = F.exp(-score)
    elif postprocess == "invert":
        score = F.lit(1.0) - score
    return score * score if power else score


def pairs(
    df: DataFrame,
    by: Sequence[str] = (),
    id: str = "id",
    vec: str = "vec",
    metric: str = "cosine",
    postprocess: str | None = None,
    power: bool = False,
    height: int = 256,
) -> DataFrame:
    """The similarity matrix as a long table ``by..., i, j, sim``, both halves and
    the diagonal.

    This is the data behind a heat map: the output itself is quadratic, so it is
    meant for groups one would draw. Block pairs spread the work of a large group. Vectors of different
    lengths, or with a null in them, have no similarity.
    """
    _check(metric, postprocess)
    src, keys = keyed(df, by)
    rows = src.select(*keys, F.col(id).alias("sid"), F.col(vec).cast("array<double>").alias("x"))
    packed = bl.pack(rows, keys, "sid", ["x"], height)
    sid, x = F.col("rows.sid"), F.col("rows.x")
    own = packed.select(*keys, sid.alias("a"), x.alias("x"), sid.alias("b"), x.alias("y"), F.lit(True).alias("own"))
    left, right = [sid.alias("a"), x.alias("x")], [sid.alias("b"), x.alias("y")]
    other = bl.block_pairs(packed, keys, left, right).select(*keys, "a", "x", "b", "y", F.lit(False).alias("own"))
    return unkeyed(by, _matrices(own.unionByName(other), keys, metric, postprocess, power))


def _rows_of(column: pa.ListArray, row: int) -> pa.Array:
    start, end = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    return column.values.slice(start, end - start)


def _filled(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix, filled up with NaN, and their lengths: -1 without a vector or with a null in it."""
    offsets = vectors.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = vectors.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    out = np.full((len(sizes), int(sizes.max(initial=0))), np.nan)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat.to_numpy(zero_copy_only=False)
    lengths = sizes.astype(np.int64)
    lengths[row[~flat.is_valid().to_numpy(zero_copy_only=False)]] = -1
    lengths[~vectors.is_valid().to_numpy(zero_copy_only=False)] = -1
    return out, lengths


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=np.nan)


def _matrices(blocks: DataFrame, keys: list[str], metric: str, postprocess: str | None, power: bool) -> DataFrame:
    """``keys..., i, j, sim`` of pairs of blocks, both halves: one matrix product a pair of blocks, and the rows of
    a matrix leave as Arrow columns, ``STRIPE`` lines at a time."""
    ident = blocks.schema["a"].dataType.elementType
    schema = T.StructType(
        [*bl.key_fields(blocks, keys), T.StructField("i", ident), T.StructField("j", ident), T.StructField("sim", T.DoubleType())]
    )

    def rows(batch, r, a, b, z, valid):
        m, n = z.shape
        at, to = np.repeat(np.arange(m), n), np.tile(np.arange(n), m)
        key = batch.select(keys).take(pa.array(np.full(m * n, r)))
        sim = pa.array(z.ravel(), mask=~valid.ravel())
        return pa.RecordBatch.from_arrays([*key.columns, a.take(pa.array(at)), b.take(pa.array(to)), sim], [*keys, "i", "j", "sim"])

    def apply(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = _rows_of(batch.column("a"), r), _rows_of(batch.column("b"), r)
                (x, m), (y, n) = _filled(_rows_of(batch.column("x"), r)), _filled(_rows_of(batch.column("y"), r))
                width = max(x.shape[1], y.shape[1])
                x, y = _widened(x, width), _widened(y, width)
                # Places that a vector does not have add nothing where both have the same length.
                x[np.arange(width)[None, :] >= m[:, None]] = 0.0
                y[np.arange(width)[None, :] >= n[:, None]] = 0.0
                comparable = (m[:, None] == n[None, :]) & (m >= 0)[:, None]
                if metric == "cosine":
                    lengths = [np.sqrt((v * v).sum(1)) for v in (x, y)]
                    x, y = (v / np.where(d == 0, 1.0, d)[:, None] for v, d in zip((x, y), lengths, strict=True))
                codes = pc.fill_null(pa.concat_arrays([a, b]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                mine, theirs = codes[: len(a)], codes[len(a) :]
                for s in range(0, len(a), STRIPE):
                    z = _similarity(x[s : s + STRIPE], y, metric, postprocess, power)
                    same = (mine[s : s + STRIPE, None] == theirs[None, :]) & (theirs >= 0)[None, :]
                    z[same] = 1.0
                    known = comparable[s : s + STRIPE] | same
                    yield rows(batch, r, a[s : s + STRIPE], b, z, known)
                    if not batch.column("own")[r].as_py():
                        yield rows(batch, r, b, a[s : s + STRIPE], z.T, known.T)

    return blocks.mapInArrow(apply, schema)
