"""Blocks of species, and sums over all pairs of a group computed block by block.

A group is cut into blocks of bounded size by a hash of the species id, so a
group of any size is spread over many rows. The sums over all pairs then come
from an equi-join of blocks with blocks; only row sums leave a pair of blocks,
never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, partitions

# A block of vectors is about this many bytes; a pair of blocks is one kernel call.
BLOCK_BYTES = 2 << 20
MAX_ROWS = 4096


def rows_per_block(dim: int) -> int:
    """Block height for vectors of ``dim`` doubles."""
    return int(max(64, min(MAX_ROWS, BLOCK_BYTES // (8 * max(1, dim)))))


def pack(
    df: DataFrame,
    keys: Sequence[str],
    id: str | None,
    columns: Sequence[str],
    height: int,
    count: str | None = None,
) -> DataFrame:
    """Group rows into blocks: ``keys..., blk, n_blk, n, rows``.

    Without an ``id`` the rows themselves must be distinct: equal rows would all
    fall into one block.

    ``rows`` is an array of structs sorted by id and content, so that a recomputed
    block lists its rows in the same order. ``n`` is the number of species of the
    group (the sum of ``count`` where rows stand for several).
    """
    return gather(df, keys, id, columns, height, count=count)


def gather(
    df: DataFrame, keys: Sequence[str], id: str | None, columns: Sequence[str], height: int, place: str | None = None, count: str | None = None
) -> DataFrame:
    """:func:`pack`, with the block of each row in the column ``place`` if it is named."""
    size = F.sum(count) if count else F.count("*")
    sizes = df.groupBy(*keys).agg(size.cast("bigint").alias("n"), F.count("*").alias("_rows"))
    ident = [id] if id else []
    spread = F.xxhash64(*(ident or columns))
    block = F.col(place) if place else F.pmod(spread, F.col("n_blk"))
    return (
        df.select(*keys, *ident, *columns, *([place] if place else []))
        .join(sizes, list(keys))
        .withColumn("n_blk", F.ceil(F.col("_rows") / F.lit(height)).cast("int"))
        .withColumn("blk", block.cast("int"))
        # A fixed number of partitions: the work per block is far larger than its
        # bytes suggest, so small blocks must not be merged into a few tasks.
        .repartition(partitions(df), *keys, "blk")
        .groupBy(*keys, "blk", "n_blk", "n")
        .agg(F.array_sort(F.collect_list(F.struct(*ident, *columns))).alias("rows"))
    )


def packed(*args, **kwargs) -> tuple[DataFrame | None, DataFrame | None]:
    """Pack and write the blocks once, then split them into groups of one block and
    groups of several; either side is ``None`` when there is none.

    The pair routes read the blocks up to four times. Reading them from the shared
    folder costs less than packing again, and keeps the plans small.
    """
    return split(cut_lineage(pack(*args, **kwargs)))


def split(blocks: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Blocks of groups of one block, and of groups of several."""
    low, high = blocks.agg(F.min("n_blk"), F.max("n_blk")).first()
    small = blocks.where(F.col("n_blk") == 1) if low == 1 or high is None else None
    large = blocks.where(F.col("n_blk") > 1) if high is not None and high > 1 else None
    return small, large


def block_pairs(blocks: DataFrame, keys: Sequence[str], left: list[Column], right: list[Column]) -> DataFrame:
    """Every unordered pair of different blocks of a group, once.

    Block ``i`` meets the blocks ``i+1 .. i+half`` around the circle, so every
    block takes part equally often on either side and the join key (group, i, j)
    spreads one large group over all partitions. ``left`` and ``right`` are the
    columns each side contributes.
    """
    half = F.floor(F.col("n_blk") / 2).cast("int")
    steps = F.sequence(F.lit(1), F.greatest(half, F.lit(1)))
    many = blocks.where(F.col("n_blk") > 1)
    # On an even circle the opposite block would be met from both ends.
    once = ~((F.col("n_blk") % 2 == 0) & (F.col("_s") == half) & (F.col("i") >= half))
    a = (
        many.withColumn("_s", F.explode(steps))
        .withColumn("i", F.col("blk"))
        .where(once)
        .withColumn("j", F.pmod(F.col("i") + F.col("_s"), F.col("n_blk")).cast("int"))
        .select(*keys, "i", "j", *left)
    )
    b = (
        many.withColumn("_s", F.explode(steps))
        .withColumn("j", F.col("blk"))
        .withColumn("i", F.pmod(F.col("j") - F.col("_s"), F.col("n_blk")).cast("int"))
        .where(once)
        .select(*keys, "i", "j", *right)
    )
    on = [*keys, "i", "j"]
    spread = partitions(blocks)
    # Both sides hold all rows of a group many times: neither may go through the driver.
    return a.repartition(spread, *on).join(b.repartition(spread, *on).hint("merge"), on)


def key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def run(
    df: DataFrame,
    keys: Sequence[str],
    kernel: Callable[[pa.RecordBatch], tuple[list[int], list[int], list[np.ndarray]]],
    value: str = "sums",
) -> DataFrame:
    """Apply a kernel to Arrow batches of block rows.

    The kernel returns, per result, the index of the input row, the block the
    result belongs to and an array. Gives ``keys..., blk, <value>``.
    """
    names = list(keys)
    schema = T.StructType(
        [
            *key_fields(df, keys),
            T.StructField("blk", T.IntegerType()),
            T.StructField(value, T.ArrayType(T.DoubleType())),
        ]
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows, blk, arrays = kernel(batch)
            if not rows:
                continue
            taken = batch.select(names).take(pa.array(rows, pa.int32()))
            lengths = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
            values = pa.ListArray.from_arrays(
                pa.array(lengths, pa.int32()), pa.array(np.concatenate(arrays).astype(np.float64))
            )
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(blk, pa.int32()), values], [*names, "blk", value]
            )

    return df.mapInArrow(apply, schema)


def run_rows(
    blocks: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    kernel: Callable[[pa.RecordBatch], list[np.ndarray]],
    inputs: Sequence[str | Column],
) -> DataFrame:
    """Apply a kernel that needs nothing but its own block and gives one number per
    row: ``keys..., n, <fields>, sum``. ``inputs`` are the columns it reads.

    The rows pass through the kernel with their numbers; no join back is needed.
    """
    slim = blocks.select(*keys, "n", *[F.col(f"rows.{f}").alias(f) for f in fields], *inputs)
    kept = [*keys, "n", *fields]
    schema = T.StructType([*[slim.schema[k] for k in kept], T.StructField("sum", T.ArrayType(T.DoubleType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            arrays = kernel(batch)
            bounds = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
            sums = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(arrays)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], sums], [*kept, "sum"])

    out = slim.mapInArrow(apply, schema)
    rows = out.select(*keys, "n", F.explode(F.arrays_zip(*fields, "sum")).alias("_r"))
    return rows.select(*keys, "n", *[F.col(f"_r.{f}").alias(f) for f in [*fields, "sum"]])


def add_up(parts: DataFrame, keys: Sequence[str], value: str = "sums") -> DataFrame:
    """Element-wise sum of the arrays of equal keys, combined map-side in the JVM."""
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col(value))))
    return parts.groupBy(*keys).agg(total.alias(value))


def unpack(
    blocks: DataFrame, sums: DataFrame, keys: Sequence[str], fields: Sequence[str], width: int = 1
) -> DataFrame:
    """Put the sums back beside their rows: ``keys..., n, <fields>, sum``; ``sum`` is
    an array when ``width`` is above one.

    Only the named fields are carried, and they are zipped before they are exploded,
    so that no row drags the arrays of its block along.
    """
    slim = blocks.select(*keys, "n", "blk", *[F.col(f"rows.{f}").alias(f) for f in fields])
    joined = slim.join(sums.withColumnRenamed("sums", "sum").hint("merge"), [*keys, "blk"])
    if width > 1:
        cut = F.transform(
            F.sequence(F.lit(0), (F.size("sum") / width).cast("int") - 1),
            lambda i: F.slice(F.col("sum"), i * width + 1, width),
        )
        joined = joined.withColumn("sum", cut)
    rows = joined.select(*keys, "n", F.explode(F.arrays_zip(*fields, "sum")).alias("_r"))
    return rows.select(*keys, "n", *[F.col(f"_r.{f}").alias(f) for f in [*fields, "sum"]])


def matrix(column: pa.ListArray, row: int) -> np.ndarray:
    """Row ``row`` of a list-of-lists column as a 2-d float64 array, without copying."""
    outer, end = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    inner = column.values
    first = inner.offsets[outer].as_py()
    last = inner.offsets[end].as_py()
    flat = inner.values.slice(first, last - first).to_numpy(zero_copy_only=False)
    return flat.reshape(end - outer, -1).astype(np.float64, copy=False)


def vector(column: pa.ListArray, row: int) -> np.ndarray:
    """Row ``row`` of a list column as a 1-d float64 array."""
    start, end = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    return column.values.slice(start, end - start).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
