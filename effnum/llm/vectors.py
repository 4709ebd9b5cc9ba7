"""Vectors as packed blocks: what the two searches share."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Stands for a null id inside the searches: larger than all others, and no id itself.
NO_ID = (1 << 63) - 1


def clean(table: DataFrame, key: str = "vec_id", vector: str = "embedding", zero: bool = True) -> DataFrame:
    """``id, v`` of every row that takes part, with v in double precision; a null id is ``NO_ID``.

    Rows with a null or empty vector or null or non-finite components are left out, and so
    are zero vectors unless ``zero``. Repeated rows stay rows of their own.
    """
    v = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = table.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), v.alias("v")).where((F.size("v") > 0) & F.forall("v", finite))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows


def asked(rows: DataFrame, every: int) -> DataFrame:
    """The queries: rows whose id is divisible by ``every``; a repeated row asks once."""
    return rows.where((F.col("id") != NO_ID) & (F.col("id") % every == 0)).dropDuplicates(["id", "v"])


def named(hits: DataFrame) -> DataFrame:
    """``hits`` with null for ``NO_ID``."""
    return hits.withColumn("vec_id", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")))


def lengths(rows: DataFrame) -> list[tuple[int, int, float]]:
    """The lengths of the vectors: each with its number of rows and largest squared norm."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*"), F.max(norm))
    return sorted(tuple(r) for r in sizes.collect())


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a batch with columns ``id`` and ``v``."""
    v = batch.column("v")
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return batch.column("id").to_numpy(zero_copy_only=False), flat.reshape(batch.num_rows, -1)


def sample(rows: DataFrame, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of about ``n`` rows by hash, at most ``2 n``, in the order of their ids."""
    share = min(1.0, n / max(1, total))
    draw = F.xxhash64("id", "v", F.lit(23))  # one id may have many vectors
    kept = rows.select("id", "v", draw.alias("_h")).where(F.pmod("_h", F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).limit(2 * n)
    got = kept.toArrow().sort_by([("id", "ascending"), ("_h", "ascending")])
    return got.column("id").to_numpy(), np.array([x for x in got.column("v").to_pylist()], np.float64)


def packed(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], height: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal ``keys`` from sorted batches, at most ``height`` rows each."""
    held: list[pa.RecordBatch] = []
    now, n = None, 0
    for b in batches:
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            own = tuple(int(c[lo]) for c in columns)
            if own != now and held:
                yield now, pa.Table.from_batches(held)
                held, n = [], 0
            now = own
            while lo < hi:
                take = min(height - n, hi - lo)
                held.append(b.slice(lo, take))
                lo, n = lo + take, n + take
                if n == height:
                    yield now, pa.Table.from_batches(held)
                    held, n = [], 0
    if held:
        yield now, pa.Table.from_batches(held)


def names() -> Iterator[int]:
    """Numbers for the blocks that a task makes, different in all tasks of a stage."""
    return itertools.count(TaskContext.get().partitionId() << 32)


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return arrays(table.combine_chunks().to_batches()[0])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id, in order."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]
