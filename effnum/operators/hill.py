"""Similarity-sensitive Hill numbers as grouped aggregates.

Input is one row per species, or one row per group of identical species:

* ``p``   abundance of the row, summing to one within a group,
* ``zp``  expected similarity of the row to a species drawn from the group,
* ``cnt`` number of species the row stands for (optional, default one),
* ``valid`` false marks a row whose text is unusable (optional).

The n x n similarity matrix never appears; how ``zp`` comes about is the business
of the similarity operators.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keyed, unkeyed

# Fixed value: keeps the logarithm finite where a species resembles nothing.
EPSILON = 1e-10
# Fixed value: below this a similarity counts as zero.
NEGLIGIBLE = 1e-8


def _raw(q: float) -> tuple[Column, Column]:
    """The aggregate behind order ``q`` and the number it turns into."""
    p, zp = F.col("p"), F.col("zp")
    if q == 1:
        positive = F.when(zp + EPSILON > 0, zp + EPSILON)
        return F.sum(p * F.log(positive)), F.exp(-F.col("_s"))
    if math.isinf(q):
        return F.max(zp), F.lit(1.0) / F.nullif(F.col("_s"), F.lit(0.0))
    return F.sum(p * F.pow(zp, F.lit(float(q - 1)))), F.pow(F.col("_s"), F.lit(1.0 / (1.0 - q)))


def diversity(
    zp: DataFrame,
    by: Sequence[str] = (),
    q: float = 1.0,
    normalize: bool = False,
    metric: str | None = None,
) -> DataFrame:
    """Effective number of species per group.

    Gives ``by..., [metric,] diversity, n_species, status, saturated``. One
    partial/final aggregate; no group is ever gathered in one place.
    """
    return _evaluate(zp, by, [q], normalize, metric).drop("q")


def profile(
    zp: DataFrame,
    by: Sequence[str] = (),
    qs: Sequence[float] = (0.0, 1.0, 2.0),
    normalize: bool = False,
    metric: str | None = None,
) -> DataFrame:
    """Diversity for several orders at once, one row per group and ``q``.

    All orders are computed in the same pass over the species.
    """
    return _evaluate(zp, by, list(qs), normalize, metric)


def _evaluate(
    zp: DataFrame, by: Sequence[str], qs: list[float], normalize: bool, metric: str | None
) -> DataFrame:
    df, keys = keyed(zp, by)
    if "cnt" not in df.columns:
        df = df.withColumn("cnt", F.lit(1).cast("bigint"))
    if "valid" not in df.columns:
        df = df.withColumn("valid", F.lit(True))
    z = F.col("zp")
    broken = F.isnan(z) | (F.abs(z) == F.lit(math.inf))
    off_diagonal = F.abs(z - F.col("p") / F.col("cnt"))
    stats = df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(z.isNotNull(), F.col("cnt"))), F.lit(0)).cast("bigint").alias("n"),
        F.min(z).alias("_lo"),
        F.max(F.abs(z)).alias("_abs"),
        F.coalesce(F.max(broken), F.lit(False)).alias("_broken"),
        F.max(off_diagonal).alias("_off"),
        F.min(F.coalesce(F.col("valid"), F.lit(False))).alias("_valid"),
        *[_raw(q)[0].alias(f"_s{k}") for k, q in enumerate(qs)],
    )
    per_q = [
        F.struct(F.lit(float(q)).alias("q"), F.col(f"_s{k}").alias("s"), F.lit(k).alias("k"))
        for k, q in enumerate(qs)
    ]
    rows = stats.withColumn("_q", F.explode(F.array(*per_q))).withColumn("_s", F.col("_q.s"))
    raw = F.lit(None).cast("double")
    for k, q in enumerate(qs):
        value = _raw(q)[1]
        if q == 1:
            value = F.when(F.col("_lo") + EPSILON > 0, value)
        raw = F.when(F.col("_q.k") == k, value).otherwise(raw)
    rows = rows.withColumn("_d", raw)
    finite = F.col("_d").isNotNull() & ~F.isnan("_d") & (F.abs(F.col("_d")) != F.lit(math.inf))
    n = F.col("n").cast("double")
    value = F.col("_d") / n if normalize else F.col("_d")
    status = (
        F.when(~F.col("_valid"), "invalid")
        .when(F.col("n") == 0, "empty")
        .when(F.col("_broken"), "nan_similarity")
        .when(F.col("_abs") <= NEGLIGIBLE, "zero_similarity")
        .when(~finite, "undefined")
        .when(F.col("_lo") < 0, "negative_zp")
        .otherwise("ok")
    )
    result = (
        F.when(F.col("status").isin("invalid", "empty"), F.lit(0.0))
        .when(F.col("status") == "nan_similarity", F.lit(1.0))
        .when(F.col("status").isin("zero_similarity", "undefined"), n)
        .otherwise(value)
    )
    out = rows.withColumn("status", status)
    label = [F.lit(metric).alias("metric")] if metric else []
    return unkeyed(
        by,
        out.select(
            *keys,
            *label,
            F.col("_q.q").alias("q"),
            result.alias("diversity"),
            F.col("n").alias("n_species"),
            "status",
            F.coalesce((F.col("n") > 1) & (F.col("_off") <= NEGLIGIBLE), F.lit(False)).alias("saturated"),
        )
    )


def mean_similarity(zp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the similarity matrix per group, diagonal included; empty groups 0."""
    df, keys = keyed(zp, by)
    return unkeyed(
        by,
        df.groupBy(*keys).agg(
            F.coalesce(F.sum(F.col("p") * F.col("zp")), F.lit(0.0)).alias("similarity")
        )
    )
