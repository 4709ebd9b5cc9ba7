"""Reading corpora into the shape the operators expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "text")


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input of few files.

    A scan with fewer partitions than cores is small by that very fact, so the
    extra shuffle is cheap. Large inputs have more partitions than cores and are
    left alone. Call this on a plain scan only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options: object) -> DataFrame:
    """Read a table and spread it over the cores."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}, expected one of {FORMATS}")
    return spread(spark.read.format(format).options(**options).load(path))


def corpus(
    df: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    by: Sequence[str] = (),
    order: str | None = None,
) -> DataFrame:
    """Normalise a table to ``by..., doc_id, text[, pos]``.

    ``order`` names the column that gives documents their sequence; it is only
    needed for windows.
    """
    chosen = [*by, F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")]
    if order:
        chosen.append(F.col(order).cast("bigint").alias("pos"))
    return df.select(*chosen)
