"""What the operators share: table access, bounded samples, bytes of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# White space of the contracts: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: str | Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts, F.lit(-1))


LABELS = 1 << 16  # so many counts of labels may be sent to every task
SALTS = 64


def bounded_sample(rows: DataFrame, label: str, key: str, per_label: int, at_most: int) -> DataFrame:
    """At most ``per_label`` rows of each label and about ``at_most`` in all, by the hash of ``key``.

    The counts are pre-aggregated and thin the rows where they are read, before any
    label is shuffled or ranked, so a label with a third of all rows never meets in one
    task. Beyond ``LABELS`` labels the counts come by a salted join instead of a broadcast.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    labels = max(1, counts.count())
    per = max(1, min(per_label, at_most // labels))
    draw = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    if labels <= LABELS:
        counted = rows.join(F.broadcast(counts), label)
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = rows.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        counted = salted.join(counts.withColumn("_s", every), [label, "_s"]).drop("_s")
    near = counted.withColumn("_d", draw).where(F.col("_d") * F.col("_n") <= 2.0 * per + 20)
    order = Window.partitionBy(label).orderBy("_d", key)
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per).drop("_n", "_d", "_r")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) in one array, and the rows' offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, starts, data = column.buffers()
    if not len(column) or starts is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(starts, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return values, offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int):
    """Runs of whole rows with about ``limit`` bytes each, as (first, last) pairs."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values[offsets[i]:offsets[i + 1]]``; empty segments give zero."""
    total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


# Powers of an odd number and of its inverse modulo 2**64, for hashes of words by prefix sums.
_ODD = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(1 << 16, _ODD, np.uint64))
_INVERSE = np.cumprod(np.full(1 << 16, pow(_ODD, -1, 1 << 64), np.uint64))


def _power(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``table[0] ** (at + 1)`` for positions of any size."""
    out = table[at & 0xFFFF]
    top = int(at.max(initial=0)) >> 16
    if top:
        steps = np.cumprod(np.concatenate([[np.uint64(1)], np.full(top, table[0xFFFF], np.uint64)]))
        out = out * steps[at >> 16]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (SplitMix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_in(text: np.ndarray, rim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of the runs outside ``rim``; ``text`` begins and ends with rim."""
    start = np.flatnonzero(rim[:-1] & ~rim[1:]) + 1
    end = np.flatnonzero(~rim[:-1] & rim[1:]) + 1
    run = np.concatenate([[np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _power(_POWERS, np.arange(len(text))))])
    word = (run[end] - run[start]) * _power(_INVERSE, start)
    return start, end, mixed(word + (end - start).astype(np.uint64))
