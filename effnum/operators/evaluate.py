"""Evaluating metrics against labelled corpora and human scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import constant, keyed, unkeyed
from .ordinals import ordinal

Metric = Callable[[DataFrame, list[str]], DataFrame]
# Fixed value: scores where a lower value means more diverse.
LOWER_IS_DIVERSE = ("self_bleu",)
STEPS = 1000  # places on the grid of quantiles that brackets a median


def score_grid(corpus: DataFrame, key: str, metrics: Mapping[str, Metric], min_docs: int = 2) -> DataFrame:
    """``key, metric, score`` for every corpus and metric; corpora with fewer than
    ``min_docs`` documents score NaN."""
    counts = corpus.groupBy(key).agg(F.count("*").alias("_n"))
    parts = [
        metric(corpus, [key]).select(key, F.lit(name).alias("metric"), F.col("diversity").cast("double").alias("score"))
        for name, metric in metrics.items()
    ]
    scores = reduce(DataFrame.unionByName, parts).join(counts, key)
    value = F.when(F.col("_n") >= min_docs, F.col("score")).otherwise(F.lit(float("nan")))
    return scores.select(key, "metric", value.alias("score"))


def oriented(metric: Column, score: Column) -> Column:
    """The score turned so that larger means more diverse."""
    return F.when(metric.isin(*LOWER_IS_DIVERSE), -score).otherwise(score)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the rank of ``value`` in its group, ties sharing their mean rank.

    Ranks are counted over the distinct values, whose counts are combined map-side;
    the running count is taken in ranges, so no group is sorted in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranged = ordinal(counts, keys, [value], "_at")
    # Positions are known; sum the counts before each in blocks of positions.
    block = F.floor(F.col("_at") / 10_000)
    placed = ranged.withColumn("_blk", block)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "_blk")
        .agg(F.sum("_c").alias("_s"))
        .select(*keys, "_blk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ranks = (
        placed.withColumn("_run", F.sum("_c").over(inside))
        .join(offsets, [*keys, "_blk"])
        .select(*keys, value, (F.col("_off") + F.col("_run") - (F.col("_c") - 1) / 2.0).alias(out))
    )
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """``by..., n, rho``: rank correlation with mean ranks for ties; rows where either
    value is missing or NaN are left out."""
    present = df.where(
        F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    )
    src, keys = keyed(present.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")), by)
    ranked = average_ranks(average_ranks(src, keys, "_x", "_rx"), keys, "_y", "_ry")
    return unkeyed(by, ranked.groupBy(*keys).agg(F.count("*").alias("n"), _corr("_rx", "_ry").alias("rho")))


def _corr(x: str, y: str) -> Column:
    """Correlation, null where a side does not vary.

    A condition around ``corr`` would not keep it from dividing by zero in a constant group.
    """
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """``by..., n, r``: plain correlation."""
    src, keys = keyed(df, by)
    present = src.where(
        F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))
    )
    return unkeyed(by, present.groupBy(*keys).agg(F.count("*").alias("n"), _corr(x, y).alias("r")))


def ordinal_correlation(df: DataFrame, by: Sequence[str], id: str, x: str, y: str) -> DataFrame:
    """``by..., n, r``: correlation of positions, ties in the order of ``id``."""
    src, keys = keyed(df.select(*by, id, F.col(x).alias("_x"), F.col(y).alias("_y")), by)
    first = ordinal(src, keys, ["_x", id], "_px")
    second = ordinal(first, keys, ["_y", id], "_py")
    return unkeyed(by, second.groupBy(*keys).agg(F.count("*").alias("n"), _corr("_px", "_py").alias("r")))


def calibration(scores: DataFrame, groups: Sequence[str], measured: str, expected: str) -> DataFrame:
    """Mean ratio and mean absolute error per combination of ``groups`` and overall.

    ``groups..., n, ratio, mae``; the overall row has nulls in the groups.
    """
    ratio = F.try_divide(F.col(measured), F.col(expected))
    error = F.abs(F.col(measured) - F.col(expected))
    columns = [F.col(g) for g in groups]
    return scores.groupingSets([columns, []], *columns).agg(
        F.count("*").alias("n"), F.avg(ratio).alias("ratio"), F.avg(error).alias("mae")
    )


def _matched(df: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row with its group's state; null is a group like any other."""
    named = state.withColumnsRenamed({k: f"_of{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys])
    return df.join(named, same).drop(*[f"_of{k}" for k in keys])


def _narrowed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., _lo, _hi, _n``: two values of each group with its median between them,
    about four steps of the grid apart, from rows with the present ``_lo`` and ``_hi``
    (null: no bound yet)."""
    x = F.col("_x")
    below = F.coalesce(x < F.col("_lo"), F.lit(False))
    above = F.coalesce(x > F.col("_hi"), F.lit(False)) | F.isnan(x)
    inside = x.isNotNull() & ~below & ~above
    grid = F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)])
    found = rows.groupBy(*keys).agg(
        F.count("_x").alias("_n"),
        F.count_if(below).alias("_b"),
        F.count_if(inside).alias("_i"),
        F.percentile_approx(F.when(inside, x), grid, 10 * STEPS).alias("_p"),
    )
    # The middle ranks, from 0, as places on the grid. The sketch is off by a tenth of a
    # step at most, and a whole step is left on either side.
    first, last = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    place = lambda rank: (rank - F.col("_b")) * F.lit(STEPS) / F.greatest(F.col("_i"), F.lit(1))
    at = lambda k: F.get("_p", F.greatest(F.lit(0), F.least(F.lit(STEPS), k)).cast("int"))
    return found.select(
        *keys,
        at(F.floor(place(first)) - 1).alias("_lo"),
        at(F.ceil(place(last + 1)) + 1).alias("_hi"),
        "_n",
    )


def exact_median(df: DataFrame, by: Sequence[str], value: str, out: str = "median", passes: int = 2) -> DataFrame:
    """``by..., n, out``: the exact median of each group, nulls left out, NaN the largest;
    ``n`` counts all rows.

    No group is sorted or held in one task. Each of ``passes`` aggregates reads the rows
    and leaves a bracket around the median, from a sketch of bounded size that is merged
    map-side; a pass narrows it to some 0.4 % of the rows in it. A last one counts what
    lies below the bracket and, by value, inside it: with two passes about 16 of a
    million rows of a group, ties once.
    """
    src, keys = keyed(df.select(*by, F.col(value).cast("double").alias("_x")), by)
    none = F.lit(None).cast("double")
    state = _narrowed(src.withColumn("_lo", none).withColumn("_hi", none), keys)
    for _ in range(passes - 1):
        state = _narrowed(_matched(src, state.drop("_n"), keys), keys)
    x = F.col("_x")
    side = F.when(x.isNull(), 3).when(F.isnan(x), 2).when(x < F.col("_lo"), -1).when(x > F.col("_hi"), 1).otherwise(0)
    placed = _matched(src, state, keys).withColumn("_side", side)
    kept = placed.withColumn("_x", F.when(F.col("_side").isin(0, 2), x))
    counts = kept.groupBy(*keys, "_side", "_x").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_side", "_x").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_to", F.sum("_c").over(order)).withColumn("_from", F.col("_to") - F.col("_c"))

    def ranked(rank: Column) -> Column:
        return F.max(F.when((F.col("_side") < 3) & (F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_x")))

    low, high = ranked(F.floor((F.col("_n") - 1) / 2)), ranked(F.floor(F.col("_n") / 2))
    middle = F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)
    missed = (F.max("_n") > 0) & (low.isNull() | high.isNull())
    checked = F.when(missed, F.raise_error(F.lit("a median lies outside its bracket"))).otherwise(middle)
    return unkeyed(by, run.groupBy(*keys).agg(F.sum("_c").alias("n"), checked.alias(out)))


def median_ratio(scores: DataFrame, by: Sequence[str], measured: str, expected: str) -> DataFrame:
    """``by..., n, median_ratio`` of measured over expected, expected above zero."""
    ratio = F.col(measured) / F.col(expected)
    rows = scores.where(F.col(expected) > 0).select(*by, ratio.alias("_ratio"))
    return exact_median(rows, by, "_ratio", "median_ratio")


def pair_accuracy(df: DataFrame, pair: str, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., n_pairs, accuracy``: share of pairs whose rows labelled 1 score higher
    on average than those labelled 0; pairs without both are left out."""
    src, keys = keyed(df, by)
    sides = src.groupBy(*keys, pair).agg(
        F.avg(F.when(F.col(label) == 1, F.col(score))).alias("_hi"),
        F.avg(F.when(F.col(label) == 0, F.col(score))).alias("_lo"),
    )
    both = sides.where(F.col("_hi").isNotNull() & F.col("_lo").isNotNull())
    right = (F.col("_hi") > F.col("_lo")).cast("double")
    return unkeyed(by, both.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.avg(right).alias("accuracy")))


def limit_pairs(df: DataFrame, pair: str, k: int) -> DataFrame:
    """Rows of the first ``k`` pair ids in order; 0 keeps all."""
    if k == 0:
        return df
    first = df.select(pair).distinct().orderBy(pair).limit(k)
    return df.join(first, pair, "left_semi")


def _sides(contrasts: DataFrame, scores: DataFrame) -> DataFrame:
    """Contrasts with the scores of both corpora, per metric."""
    value = oriented(F.col("metric"), F.col("score"))
    usable = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    hi = usable.select(F.col("corpus").alias("greater"), "metric", value.alias("_hi"))
    lo = usable.select(F.col("corpus").alias("lesser"), "metric", value.alias("_lo"))
    return contrasts.join(hi, "greater").join(lo, ["lesser", "metric"])


def contrast_accuracy(contrasts: DataFrame, scores: DataFrame) -> DataFrame:
    """``metric, level, kind, n, accuracy``: share of ``contrasts(level, kind, greater,
    lesser)`` that ``scores(corpus, metric, score)`` order as expected."""
    right = (F.col("_hi") > F.col("_lo")).cast("double")
    return _sides(contrasts, scores).groupBy("metric", "level", "kind").agg(
        F.count("*").alias("n"), F.avg(right).alias("accuracy")
    )


def inverse_pair_rate(contrasts: DataFrame, scores: DataFrame) -> DataFrame:
    """``metric, n_pairs, rate`` over the semantic inverse pairs."""
    chosen = contrasts.where((F.col("level") == "semantic") & (F.col("kind") == "inverse_pair"))
    right = (F.col("_hi") > F.col("_lo")).cast("double")
    return _sides(chosen, scores).groupBy("metric").agg(F.count("*").alias("n_pairs"), F.avg(right).alias("rate"))


def within_corpus(checks: DataFrame, scores: DataFrame, levels: Mapping[str, str]) -> DataFrame:
    """``corpus, greater_level, lesser_level, greater, lesser, satisfied``: whether one
    level's metric exceeds another's on the same corpus. ``levels`` maps a level to
    its metric."""
    table = F.create_map(*[F.lit(v) for pair in levels.items() for v in pair])
    named = checks.withColumn("_gm", F.try_element_at(table, F.col("greater_level"))).withColumn(
        "_lm", F.try_element_at(table, F.col("lesser_level"))
    )
    hi = scores.select("corpus", F.col("metric").alias("_gm"), F.col("score").alias("greater"))
    lo = scores.select("corpus", F.col("metric").alias("_lm"), F.col("score").alias("lesser"))
    joined = named.join(hi, ["corpus", "_gm"]).join(lo, ["corpus", "_lm"])
    return joined.select(
        "corpus", "greater_level", "lesser_level", "greater", "lesser", (F.col("greater") > F.col("lesser")).alias("satisfied")
    )


def leaderboard(df: DataFrame, score: str, order: str = "high") -> DataFrame:
    """Best first: ``high`` values, ``low`` values, or values ``near_one``."""
    orders = {"high": F.desc(score), "low": F.asc(score), "near_one": F.abs(F.col(score) - 1).asc()}
    if order not in orders:
        raise ValueError(f"unknown order {order!r}")
    return df.orderBy(orders[order])


def max_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every column over its own maximum; the maxima are one broadcast row."""
    tops = df.agg(*[F.max(c).alias(f"_max_{c}") for c in columns])
    key = "_one"
    # One row on the right: joined on a constant that Catalyst does not fold.
    left = df.withColumn(key, constant(columns[0]))
    right = tops.withColumn(key, constant(f"_max_{columns[0]}"))
    out = left.join(F.broadcast(right), key).drop(key)
    for c in columns:
        out = out.withColumn(c, F.try_divide(F.col(c), F.col(f"_max_{c}"))).drop(f"_max_{c}")
    return out
