"""Diversity of corpora too large to compare pairwise: nested samples, a growth
curve, and its value at the full size."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import keyed, unkeyed
from .ordinals import head

Metric = Callable[[DataFrame, list[str]], DataFrame]

# Box of (a, b, c) per growth model, in the order they are tried.
BOUNDS: dict[str, tuple[tuple[float, float], tuple[float, float], tuple[float, float]]] = {
    "logarithmic": ((0.0, 1.0), (0.1, 1000.0), (-10.0, 10.0)),
    "power_law": ((0.0, 10.0), (0.01, 1.0), (-10.0, 10.0)),
    "asymptotic": ((0.0, 10.0), (10.0, 10000.0), (-10.0, 10.0)),
}
# Fixed value: advantage of the asymptotic model where the metric converges.
ASYMPTOTIC_BONUS = 0.9
GRID, REFINEMENTS = 400, 6
FEW_GROUPS = 10_000  # groups whose keys are sent to every task


def ladder(base: int, max_size: int, growth: float) -> list[int]:
    """Sample sizes for a corpus larger than ``max_size``."""
    if growth <= 1 or base < 1:
        raise ValueError("base must be positive and growth above 1")
    sizes, size = [], base
    while size <= max_size:
        sizes.append(size)
        size = max(size + 1, int(size * growth))
    return sizes if len(sizes) >= 2 else [base, max_size]


def nested_samples(
    df: DataFrame, by: Sequence[str], id: str, sizes: Sequence[int], trials: int, seed: int
) -> DataFrame:
    """``by..., trial, size, id``: per trial one random order, its prefixes the samples.

    The order is md5 of seed, trial and id. Each group is ranked in salted parts
    first; only the head of every part reaches the final ranking. The texts are not
    part of it.
    """
    largest = max(sizes)
    ids = df.select(*by, id, F.explode(F.array(*[F.lit(t) for t in range(trials)])).alias("trial"))
    order = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("trial")).cast("string"), F.col(id).cast("string")))
    ranked = head(ids.withColumn("_o", order), [*by, "trial"], ["_o", id], largest, id, "_rank")
    listed = F.filter(F.array(*[F.lit(int(s)) for s in sizes]), lambda s: s >= F.col("_rank"))
    return ranked.select(*by, "trial", F.explode(listed).alias("size"), id)


def _features(model: str, n: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of each model that its two linear parameters scale."""
    if model == "logarithmic":
        return np.log(n[None, :] + b[:, None])
    if model == "power_law":
        return n[None, :] ** b[:, None]
    return 1.0 - np.exp(-n[None, :] / b[:, None])


def _boxed(f: np.ndarray, y: np.ndarray, box_a, box_c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``a, c`` in their box for every row of ``f``, and the squared error.

    The problem is convex: its optimum is the free one or lies on an edge.
    """
    fm, ym = f.mean(1), y.mean()
    var = ((f - fm[:, None]) ** 2).sum(1)
    cov = ((f - fm[:, None]) * (y - ym)).sum(1)
    a = np.divide(cov, var, out=np.zeros_like(cov), where=var > 0)
    choices = [(a, ym - a * fm)]
    for edge in box_a:
        fixed = np.full_like(a, edge)
        choices.append((fixed, np.clip(ym - fixed * fm, *box_c)))
    square = (f**2).sum(1)
    for edge in box_c:
        slope = np.divide((f * (y - edge)).sum(1), square, out=np.zeros_like(square), where=square > 0)
        choices.append((np.clip(slope, *box_a), np.full_like(a, edge)))
    best = np.full(len(f), np.inf)
    keep_a, keep_c = np.zeros(len(f)), np.zeros(len(f))
    for ca, cc in choices:
        inside = (ca >= box_a[0]) & (ca <= box_a[1]) & (cc >= box_c[0]) & (cc <= box_c[1])
        error = ((y[None, :] - ca[:, None] * f - cc[:, None]) ** 2).mean(1)
        better = inside & (error < best)
        best = np.where(better, error, best)
        keep_a, keep_c = np.where(better, ca, keep_a), np.where(better, cc, keep_c)
    return keep_a, keep_c, best


def fit_curve(
    sizes: Sequence[float], means: Sequence[float], prefer_asymptotic: bool = False, bounds: Mapping = BOUNDS
) -> tuple[str, float, float, float, float]:
    """``model, a, b, c, rmse`` of the best growth model.

    For a fixed ``b`` every model is linear in ``a`` and ``c``, so only ``b`` is
    searched, on a grid that is refined around its best point.
    """
    n, y = np.asarray(sizes, dtype=float), np.asarray(means, dtype=float)
    found, best = None, np.inf
    for model, (box_a, box_b, box_c) in bounds.items():
        low, high = box_b
        for _ in range(REFINEMENTS):
            grid = np.geomspace(low, high, GRID)
            a, c, error = _boxed(_features(model, n, grid), y, box_a, box_c)
            k = int(error.argmin())
            low, high = grid[max(0, k - 1)], grid[min(GRID - 1, k + 1)]
        rmse = float(np.sqrt(error[k]))
        adjusted = rmse * ASYMPTOTIC_BONUS if prefer_asymptotic and model == "asymptotic" else rmse
        if adjusted < best:
            best, found = rmse, (model, float(a[k]), float(grid[k]), float(c[k]), rmse)
    if found is None:
        slope = (y[-1] - y[0]) / (n[-1] - n[0])
        return "linear", float(slope), 0.0, float(y[0] - slope * n[0]), 0.0
    return found


FIT = T.StructType(
    [
        T.StructField("model", T.StringType()),
        *[T.StructField(f, T.DoubleType()) for f in ("a", "b", "c", "rmse")],
    ]
)


def _fit_udf(prefer_asymptotic: bool, bounds: Mapping):
    @F.pandas_udf(FIT)
    def fit(sizes: pd.Series, means: pd.Series) -> pd.DataFrame:
        rows = [
            fit_curve(s, m, prefer_asymptotic, bounds) if len(s) >= 2 else (None,) * 5
            for s, m in zip(sizes, means, strict=True)
        ]
        return pd.DataFrame(rows, columns=["model", "a", "b", "c", "rmse"])

    return fit


def predict(model: str, a: str, b: str, c: str, n: Column) -> Column:
    """The growth curve at ``n``, as an expression."""
    m, pa_, pb, pc = F.col(model), F.col(a), F.col(b), F.col(c)
    return (
        F.when(m == "logarithmic", pa_ * F.log(n + pb) + pc)
        .when(m == "power_law", pa_ * F.pow(n, pb) + pc)
        .when(m == "asymptotic", pa_ * (F.lit(1.0) - F.exp(-n / pb)) + pc)
        .otherwise(pa_ * n + pc)
    )


def fit_growth(
    points: DataFrame,
    by: Sequence[str] = (),
    size: str = "size",
    mean: str = "mean",
    prefer_asymptotic: bool = False,
    bounds: Mapping = BOUNDS,
) -> DataFrame:
    """``by..., model, a, b, c, rmse`` of the curve through each group's points.

    One row per group holds its handful of points; thousands of groups are fitted
    in parallel.
    """
    src, keys = keyed(points, by)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(size).cast("double").alias("s"), F.col(mean).cast("double").alias("m"))))
    gathered = src.groupBy(*keys).agg(ordered.alias("_p")).select(
        *keys, F.col("_p.s").alias("_s"), F.col("_p.m").alias("_m")
    )
    fitted = gathered.withColumn("_f", _fit_udf(prefer_asymptotic, bounds)("_s", "_m"))
    return unkeyed(by, fitted.select(*keys, "_f.*"))


def estimate_diversity(
    df: DataFrame,
    by: Sequence[str],
    metric: Metric,
    id: str = "doc_id",
    base: int = 50,
    max_size: int = 200,
    trials: int = 2,
    growth: float = 2.0,
    seed: int = 42,
    normalize: bool = False,
    bounds: Mapping = BOUNDS,
) -> DataFrame:
    """Estimated diversity per group, as one row of
    ``by..., diversity, std, ci95, method, model, params, sample_sizes, means, stds,
    corpus_size, fit_rmse``.

    Groups up to ``max_size`` are measured directly. For larger ones every sample of
    every trial is a group of one corpus, so a single run of the metric measures
    them all. ``normalize`` says that the metric converges with size.
    """
    src, keys = keyed(df, by)
    sizes = src.groupBy(*keys).agg(F.count("*").alias("corpus_size"))
    steps = ladder(base, max_size, growth)

    # A group's rows all have one key. So a few groups are sent to the rows, never the rows to their group.
    few = sizes.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS

    def of(wanted: Column) -> DataFrame:
        groups = sizes.where(wanted).drop("corpus_size")
        return src.join(F.broadcast(groups) if few else groups, keys, "left_semi")

    small = of(F.col("corpus_size") <= max_size)
    direct = metric(small, keys).select(*keys, F.col("diversity").cast("double").alias("_direct"))

    large = of(F.col("corpus_size") > max_size)
    chosen = nested_samples(large, keys, id, steps, trials, seed)
    corpora = large.join(chosen, [*keys, id])
    measured = metric(corpora, [*keys, "trial", "size"]).select(*keys, "size", "diversity")
    finite = measured.where(
        F.col("diversity").isNotNull() & ~F.isnan("diversity") & (F.abs("diversity") != F.lit(float("inf")))
    )
    per_size = finite.groupBy(*keys, "size").agg(
        F.avg("diversity").alias("mean"), F.stddev_pop("diversity").alias("std")
    )
    row = F.struct("size", "mean", "std")
    gathered = per_size.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_p"))
    curves = gathered.select(
        *keys,
        F.col("_p.size").alias("sample_sizes"),
        F.col("_p.mean").alias("means"),
        F.col("_p.std").alias("stds"),
    ).withColumn("_f", _fit_udf(normalize, bounds)(F.col("sample_sizes").cast("array<double>"), F.col("means")))

    out = sizes.join(direct, keys, "left").join(curves, keys, "left").select("*", "_f.*").drop("_f")
    n = F.col("corpus_size").cast("double")
    points = F.coalesce(F.size("sample_sizes"), F.lit(0))
    enough, some = points >= 2, points == 1
    is_direct = F.col("corpus_size") <= max_size
    failed = is_direct & F.col("_direct").isNull()
    method = (
        F.when(failed, "error").when(is_direct, "direct").when(enough, "extrapolation").when(some, "partial").otherwise("error")
    )
    mean_std = F.aggregate("stds", F.lit(0.0), lambda s, v: s + v) / points
    distance = F.log(n / F.element_at(F.col("sample_sizes"), -1)) / F.log(F.lit(2.0)) + 1
    out = out.withColumn("method", method)
    how = F.col("method")
    out = out.withColumn(
        "diversity",
        F.when(how == "direct", F.col("_direct"))
        .when(how == "extrapolation", predict("model", "a", "b", "c", n))
        .when(how == "partial", F.col("means")[0])
        .otherwise(F.lit(0.0)),
    ).withColumn(
        "std",
        F.when(how == "extrapolation", mean_std * distance).when(how == "partial", F.col("stds")[0]).otherwise(F.lit(0.0)),
    )
    spread = F.lit(1.96) * F.col("std")
    interval = F.when(how.isin("direct", "extrapolation"), F.array(F.col("diversity") - spread, F.col("diversity") + spread))
    params = F.when(F.col("model") == "linear", F.array("a", "c")).when(F.col("model").isNotNull(), F.array("a", "b", "c"))
    return unkeyed(
        by,
        out.select(
            *keys,
            "diversity",
            "std",
            interval.alias("ci95"),
            "method",
            "model",
            params.alias("params"),
            "sample_sizes",
            "means",
            "stds",
            "corpus_size",
            F.col("rmse").alias("fit_rmse"),
        )
    )
