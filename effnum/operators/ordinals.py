"""Positions of rows in an order, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "pos") -> DataFrame:
    """Add ``out``: the zero-based position of each row within its group.

    Rows are range-partitioned by group and order, numbered within each range, and
    shifted by the sizes of the ranges before. The ranges are written once, since
    their borders come from a sample and must not move between the two uses.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(k) for k in keys], *cols).withColumn("_part", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_part")
        .agg(F.count("*").alias("_c"))
        .select(*keys, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*cols)) - 1
    numbered = ranged.withColumn("_loc", local).join(offsets, [*keys, "_part"])
    return numbered.withColumn(out, (F.col("_off") + F.col("_loc")).cast("bigint")).drop("_part", "_loc", "_off")


SALTS = 64  # parts a group is ranked in before the final ranking


def head(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, salt: str, out: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of every group with their one-based ``out``.

    The group is ranked in salted parts first (``salt`` names a column that varies
    within it), so no task sees more than ``k`` rows per part.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    part = Window.partitionBy(*keys, "_salt").orderBy(*cols)
    whole = Window.partitionBy(*keys).orderBy(*cols)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    kept = salted.withColumn(out, F.row_number().over(part)).where(F.col(out) <= k).drop("_salt", out)
    return kept.withColumn(out, F.row_number().over(whole)).where(F.col(out) <= k)
