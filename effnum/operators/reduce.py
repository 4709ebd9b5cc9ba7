"""Principal components per group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keyed, unkeyed
from . import blocks as bl
from .vectors import _second_moment


def pca(
    df: DataFrame,
    by: Sequence[str] = (),
    id: str = "id",
    vec: str = "vec",
    n_components: int | str = "auto",
    dim: int = 256,
    out: str = "pca",
) -> DataFrame:
    """Add ``out``: the centred vector projected on the group's first components.

    ``"auto"`` takes ``min(max(2, n // 10), d)`` components. The vectors stay as
    they are where the number is not between one and d - 1, or for a single row.
    The moments are summed by Spark; only the d x d eigenproblem of each group
    runs as one task.
    """
    src, keys = keyed(df, by)
    rows = src.withColumn("_x", F.col(vec).cast("array<double>"))
    slim = rows.where(F.col("_x").isNotNull()).select(
        *keys, F.col(id).alias("sid"), F.col("_x").alias("x"), F.lit(1.0).alias("p")
    )
    packed = bl.pack(slim, keys, "sid", ["x", "p"], bl.rows_per_block(dim))
    sizes = packed.groupBy(*keys).agg(F.first("n").alias("n"))
    moments = _second_moment(packed, keys).join(sizes, keys)

    @F.pandas_udf("array<array<double>>")
    def components(n: pd.Series, m1: pd.Series, m2: pd.Series) -> pd.Series:
        found = []
        for size, first, second in zip(n, m1, m2, strict=True):
            mean = np.asarray(first) / size
            gram = np.vstack([np.asarray(line) for line in second])
            d = len(mean)
            k = min(max(2, int(size) // 10), d) if n_components == "auto" else int(n_components)
            if size < 2 or not 0 < k < d:
                found.append(None)
                continue
            cov = gram / size - np.outer(mean, mean)
            _, axes = np.linalg.eigh((cov + cov.T) / 2)
            top = axes[:, ::-1][:, :k].T
            # The sign of an axis is arbitrary: make its largest entry positive.
            lead = np.abs(top).argmax(axis=1)
            top = top * np.sign(top[np.arange(k), lead])[:, None]
            found.append([list(a) for a in top])
        return pd.Series(found)

    axes = moments.select(
        *keys,
        F.transform("m1", lambda v: v / F.col("n")).alias("_mean"),
        components("n", "m1", "m2").alias("_axes"),
    )
    joined = rows.join(axes, keys, "left")
    centred = F.zip_with("_x", "_mean", lambda v, m: v - m)
    projected = F.transform(
        "_axes",
        lambda a: F.aggregate(F.zip_with(a, centred, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t),
    )
    value = F.when(F.col("_axes").isNull(), F.col("_x")).otherwise(projected)
    return unkeyed(by, joined.withColumn(out, value).drop("_x", "_mean", "_axes"))
