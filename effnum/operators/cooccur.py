"""Word vectors from the words' neighbours, learned on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import cut_lineage

SPARE = 8  # columns beyond those asked for, which let the wanted ones settle sooner
TINY = 1e-10  # directions with less than this share of the largest one's square are noise


def cooccurrences(df: DataFrame, text: str = "text", reach: int = 5) -> DataFrame:
    """``a, b, n``: how often two words stand at most ``reach`` places apart, in either
    order; a word beside itself counts in both.

    Pairs are counted map-side before the one shuffle, so frequent pairs are not hot.
    """
    toks = df.select(tx.tokens(text).alias("_t"))
    size = F.size("_t")
    near = F.array(
        *[
            F.arrays_zip(
                F.slice("_t", 1, F.greatest(size - k, F.lit(0))).alias("a"), F.slice("_t", k + 1, F.greatest(size - k, F.lit(0))).alias("b")
            )
            for k in range(1, reach + 1)
        ]
    )
    met = toks.select(F.explode(near).alias("_z")).select(F.explode("_z").alias("_p"))
    one = met.groupBy(F.least("_p.a", "_p.b").alias("a"), F.greatest("_p.a", "_p.b").alias("b")).agg(F.count("*").alias("n"))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (F.col("n") * 2).alias("n")))).otherwise(
        F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    )
    return one.select(F.inline(both))


def associations(pairs: DataFrame) -> DataFrame:
    """``a, b, m`` from ``a, b, n``: positive pointwise mutual information."""
    totals = pairs.groupBy("a").agg(F.sum("n").alias("_n"))
    everything = F.broadcast(totals.agg(F.sum("_n").cast("double").alias("_all")).withColumn("_one", F.lit(0)))
    shares = totals.withColumn("_one", F.pmod(F.hash("a"), F.lit(1))).join(everything, "_one")
    left = shares.select("a", (F.col("_n") / F.col("_all")).alias("_pa"), "_all")
    right = totals.select(F.col("a").alias("b"), F.col("_n").alias("_nb"))
    m = F.log(F.col("n") / (F.col("_pa") * F.col("_nb")))
    # Spark takes an exploded table for no larger than its input, and would broadcast the pairs.
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", m.alias("m")).where(F.col("m") > 0)


def _columns(k: int) -> list[str]:
    return [f"x{j}" for j in range(k)]


def _gram(rows: DataFrame, k: int) -> np.ndarray:
    """The k x k products of the columns, summed on the executors."""

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for frame in frames:
            x = frame.to_numpy(dtype=float)
            total += x.T @ x
        yield pd.DataFrame({"at": np.arange(k * k), "s": total.ravel()})

    parts = rows.select(*_columns(k)).mapInPandas(products, "at long, s double")
    out = np.zeros(k * k)
    # k * k numbers, whatever the number of words.
    for row in parts.groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[row.at] = row.s
    return out.reshape(k, k)


def _turned(rows: DataFrame, k: int, turn: np.ndarray) -> DataFrame:
    """The rows' vectors times a small matrix."""
    names = _columns(turn.shape[1])
    schema = T.StructType([rows.schema["a"], *[T.StructField(c, T.DoubleType()) for c in names]])

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = pd.DataFrame(frame[_columns(k)].to_numpy(dtype=float) @ turn, columns=names)
            found.insert(0, "a", frame["a"].to_numpy())
            yield found

    return rows.mapInPandas(apply, schema)


def leading_vectors(matrix: DataFrame, dim: int, passes: int = 8, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """``a, x0 ..`` and the singular values: the left singular vectors of a symmetric sparse
    ``a, b, m``, each times the square root of its value, largest first.

    Subspace iteration: a pass multiplies the matrix with a block of ``dim + SPARE`` columns,
    one join on ``b`` and one aggregate on ``a`` of plain sums; only the block's small Gram
    matrix reaches the driver. There may be fewer columns than asked for, if the matrix has no more.
    """
    k = dim + SPARE
    start = [F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(j), "a"), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias(f"x{j}") for j in range(k)]
    kept = cut_lineage(matrix)
    block = kept.select("a").distinct().select("a", *start)
    values = np.zeros(0)
    for step in range(passes):
        names = _columns(k)
        far = block.withColumnRenamed("a", "b")
        sums = [F.sum(F.col("m") * F.col(c)).alias(c) for c in names]
        product = cut_lineage(kept.join(far.hint("merge"), "b").groupBy("a").agg(*sums))
        squares, axes = np.linalg.eigh(_gram(product, k))
        order = np.argsort(squares)[::-1]
        order = order[squares[order] > TINY * max(squares.max(), 0.0)]
        values = np.sqrt(squares[order])
        last = step == passes - 1
        if last:
            order, values = order[:dim], values[:dim]
        turn = axes[:, order] / (np.sqrt(values) if last else values)
        block, k = _turned(product, k, turn), len(order)
        if k == 0:
            break
    return block, values


def word_vectors(
    df: DataFrame, text: str = "text", dim: int = 64, min_count: int = 1, reach: int = 5, passes: int = 8, seed: int = 42
) -> DataFrame:
    """``word, vec`` for every word found ``min_count`` times or more: leading singular vectors
    of the positive mutual information of neighbouring words.

    No step holds the vocabulary or the corpus in one place. A word without neighbours, and the
    components that the matrix does not have, are zeros. Null and empty texts have no words.
    """
    counted = df.select(F.explode(tx.tokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("_n"))
    words = counted.where(F.col("_n") >= min_count).select("word")
    pairs = cooccurrences(df, text, reach)
    if min_count > 1:
        pairs = pairs.join(words.withColumnRenamed("word", "a").hint("merge"), "a", "left_semi").join(
            words.withColumnRenamed("word", "b").hint("merge"), "b", "left_semi"
        )
    found, values = leading_vectors(associations(pairs), dim, passes, seed)
    have = [F.coalesce(F.col(c), F.lit(0.0)) for c in _columns(len(values))]
    vec = F.array(*have, *[F.lit(0.0)] * (dim - len(have)))
    return words.join(found.withColumnRenamed("a", "word").hint("merge"), "word", "left").select("word", vec.alias("vec"))
