"""The mergeable measures over event-time windows of a stream.

With cosine similarity and order 2 the diversity is ``n^2 / |sum of unit vectors|^2``,
so count and vector sum are all the state a window needs; with squared cosines, count and
the sum of the vectors' outer products. Ratios of distinct to all tokens keep a sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx


def _windowed(df: DataFrame, ts: str, length: str, slide: str | None, late: str) -> tuple[DataFrame, list]:
    span = F.window(ts, length, slide) if slide else F.window(ts, length)
    return df.withWatermark(ts, late), [span.alias("window")]


def semantic_diversity(
    df: DataFrame,
    ts: str,
    vec: str,
    length: str,
    slide: str | None = None,
    late: str = "10 minutes",
    by: Sequence[str] = (),
) -> DataFrame:
    """``window, by..., n_species, diversity``: order-2 cosine diversity per window.

    Works on a stream and on a table alike.
    """
    unit = df.withColumn("_x", vx.unit(F.col(vec).cast("array<double>")))
    marked, span = _windowed(unit, ts, length, slide, late)
    sums = marked.groupBy(*span, *by).agg(
        F.count("_x").alias("n_species"),
        vector_to_array(Summarizer.sum(array_to_vector("_x"))).alias("_s"),
        F.sum(vx.squared_norm("_x")).alias("_d"),
    )
    n = F.col("n_species").cast("double")
    # The diagonal counts one, also for a zero vector.
    value = F.try_divide(n * n, vx.squared_norm("_s") + n - F.col("_d"))
    return sums.select("window", *by, "n_species", value.alias("diversity"))


def squared_diversity(
    df: DataFrame,
    ts: str,
    vec: str,
    length: str,
    slide: str | None = None,
    late: str = "10 minutes",
    by: Sequence[str] = (),
    id: str | None = None,
) -> DataFrame:
    """``window, by..., n_species, diversity``: order-2 diversity of squared cosines per window.

    Works on a stream and on a table alike. The sum of all squared cosines is the squared
    norm of the vectors' second moment, of which the half above the diagonal is kept:
    ``d (d + 1) / 2`` numbers a window and group, merged map-side, whatever its number of rows.

    With ``id`` a row that comes again counts once: in a stream within the time that late
    rows have, in a table altogether. A null vector is left out, a zero one is similar to
    itself alone.
    """
    unit = df.withColumn("_x", vx.unit(F.col(vec).cast("array<double>"))).where(F.col("_x").isNotNull())
    marked, span = _windowed(unit, ts, length, slide, late)
    if id is not None:
        marked = marked.dropDuplicatesWithinWatermark([id]) if df.isStreaming else marked.dropDuplicates([id])
    x, root = F.col("_x"), F.lit(2.0**0.5)
    # Off the diagonal a product stands for two.
    products = F.transform(
        x, lambda a, i: F.transform(F.slice(x, i + 1, F.size(x)), lambda b, j: F.when(j == 0, a * b).otherwise(a * b * root))
    )
    sums = marked.withColumn("_o", F.flatten(products)).groupBy(*span, *by).agg(
        F.count("_x").alias("n_species"),
        vector_to_array(Summarizer.sum(array_to_vector("_o"))).alias("_s"),
        F.sum(vx.squared_norm("_x")).alias("_d"),
    )
    n = F.col("n_species").cast("double")
    value = F.try_divide(n * n, vx.squared_norm("_s") + n - F.col("_d"))
    return sums.select("window", *by, "n_species", value.alias("diversity"))


def type_token_ratio(
    df: DataFrame,
    ts: str,
    text: str,
    length: str,
    slide: str | None = None,
    late: str = "10 minutes",
    by: Sequence[str] = (),
) -> DataFrame:
    """``window, by..., n_total, n_distinct, value`` with a sketched distinct count."""
    words = df.select(ts, *by, F.explode(tx.tokens(text)).alias("_t"))
    marked, span = _windowed(words, ts, length, slide, late)
    out = marked.groupBy(*span, *by).agg(
        F.count("_t").alias("n_total"), F.approx_count_distinct("_t", 0.02).alias("n_distinct")
    )
    return out.withColumn("value", F.try_divide(F.col("n_distinct"), F.col("n_total")))
