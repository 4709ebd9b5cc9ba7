"""Diversity of symbol sequences: tags, rhythm codes, phonemes.

Equal sequences are counted, not repeated, so the quadratic part runs over the
distinct sequences of a group. Two sequences are scored by global alignment; the
default scores (match 1, mismatch 0, gap 0) make that the length of the longest
common subsequence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, keyed, unkeyed
from . import blocks as bl
from . import hill, tiles
from .ordinals import ordinal

HEIGHT = 256  # distinct sequences per block
TABLE_BYTES = 32 << 20  # bound on the working tables of one scoring step
FEW = 300  # pairs below which whole integers beat arrays
CELLS = 16384  # words of a diagonal: small enough for a cache
LANES = 48  # pairs of like sizes that are worth a word
HELD = 500_000  # pairs gathered before they are scored
LIKE = 0.2  # pairs are scored together if the logarithms of their left sizes fall into one step of this width
LCS = (1.0, 0.0, 0.0)


def _words(length: int) -> int:
    return max(1, -(-length // 64))


def _common_lengths(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Longest common subsequence of many pairs at once, bit-parallel.

    Where many pairs are of like sizes, they are filled up and lie side by side in the bits of words; the others
    have the bits of their shorter sequences in words of their own.
    """
    out = np.zeros(len(left), dtype=np.float64)
    swap = sizes[left] > sizes[right]
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    order = np.flatnonzero(sizes[left] > 0)  # nothing is common with an empty sequence
    step = np.floor(np.log(sizes[left[order]]) / LIKE)
    order = order[np.lexsort((sizes[right[order]], step))]
    far, step = sizes[right[order]], np.floor(np.log(sizes[left[order]]) / LIKE)
    others, at = [], 0
    while at < len(order):
        longest = int(np.exp((step[at] + 1) * LIKE)) + 1
        room = 64 * max(1, min(CELLS // longest, TABLE_BYTES // (64 * int(longest + far[at]))))
        stop = min(at + room, int(np.searchsorted(step, step[at], side="right")))
        stop = at + int(np.searchsorted(far[at:stop], 1.3 * far[at] + 4, side="right"))
        pick = order[at:stop]
        if len(pick) >= LANES and len(pick) * longest >= 4 * CELLS:
            out[pick] = _score_lanes(codes, starts, sizes, left[pick], right[pick])
        else:
            others.append(pick)
        at = stop
    if others:
        rest = np.concatenate(others)
        out[rest] = _score_own(codes, starts, sizes, left[rest], right[rest])
    return out


def _lanes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, who: np.ndarray, planes: int, fill: int, flip: int) -> np.ndarray:
    """Bit ``k`` of the codes of all sequences ``who``, position by position, 64 sequences a word."""
    own, slot = np.unique(who, return_inverse=True)
    length = int(sizes[own].max())
    place = np.arange(length)
    there = place[None, :] < sizes[own][:, None]
    table = np.full((len(own), length), fill, codes.dtype)
    table[there] = codes[np.repeat(starts[own] - np.r_[0, np.cumsum(sizes[own])[:-1]], sizes[own]) + np.arange(int(sizes[own].sum()))]
    table = np.ascontiguousarray((table ^ flip).T)
    slot = np.concatenate([slot, np.zeros(-len(slot) % 64, slot.dtype)])
    out = np.empty((planes, length, len(slot) // 64), np.uint64)
    for k in range(planes):
        bits = ((table >> k) & 1).astype(np.uint8)
        out[k] = np.packbits(np.take(bits, slot, axis=1), axis=1).view(np.uint64)
    return out


def _score_lanes(codes, starts, sizes, left, right) -> np.ndarray:
    """The steps of the lengths' table, along its diagonals: 0 or 1 down (``down``) and across (``over``). A cell
    gains one over its upper left neighbour if its symbols agree or either step into it does."""
    top = int(codes.max(initial=0)) + 1
    planes = (top + 1).bit_length()
    kind = np.uint8 if planes <= 8 else np.int64
    codes = codes.astype(kind)
    # The symbols that fill up either side, ``top`` and ``top + 1``, agree with none. One side is flipped: equal bits differ.
    a = _lanes(codes, starts, sizes, left, planes, top, (1 << planes) - 1)
    b = np.ascontiguousarray(_lanes(codes, starts, sizes, right, planes, top + 1, 0)[:, ::-1])
    (_, n, width), m = a.shape, b.shape[1]
    down = np.zeros((n, width), np.uint64)
    over, after = np.zeros((m, width), np.uint64), np.zeros((m, width), np.uint64)
    agree = np.empty((planes, min(n, m), width), np.uint64)
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d) + 1
        at = m - 1 - d + lo
        to = at + hi - lo
        same, v, h = agree[:, : hi - lo], down[lo:hi], over[at:to]
        np.bitwise_xor(a[:, lo:hi], b[:, at:to], out=same)
        x = same[0]
        for y in same[1:]:
            np.bitwise_and(x, y, out=x)
        np.bitwise_or(x, v, out=x)
        np.bitwise_or(x, h, out=x)
        np.bitwise_xor(x, v, out=after[at:to])
        np.bitwise_xor(x, h, out=v)
        over, after = after, over
    total = np.zeros(width * 64, np.int64)
    for lo in range(0, n, 128):
        total += np.unpackbits(down[lo : lo + 128].view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return total[: len(left)].astype(np.float64)


def _score_own(codes, starts, sizes, left, right) -> np.ndarray:
    """Hyyro's recurrence (2004), one bit per position of the left sequence and one
    numpy step per position of the right ones, over all pairs together."""
    out = np.zeros(len(left), dtype=np.float64)
    # Pairs with left sequences of similar length share a word count.
    order = np.lexsort((-sizes[right], left, sizes[left]))
    symbols = int(codes.max()) + 1 if len(codes) else 1
    at = 0
    while at < len(order):
        # As many left sequences as fit the table.
        width = _words(int(sizes[left[order[at]]]))
        room = max(1, TABLE_BYTES // (8 * symbols * width))
        chunk_left = left[order[at:]]
        first = np.r_[True, chunk_left[1:] != chunk_left[:-1]]
        rank = np.cumsum(first) - 1
        same_width = -(-np.maximum(sizes[chunk_left], 1) // 64) == width
        limit = max(1, TABLE_BYTES // (8 * 4 * width))
        inside = (rank < room) & same_width
        stop = len(inside) if inside.all() else int(np.argmin(inside))
        stop = max(1, min(stop, limit))
        pick = order[at : at + stop]
        score = _score_few if stop < FEW else _score_chunk
        out[pick] = score(codes, starts, sizes, left[pick], right[pick], symbols, width)
        at += stop
    return out


def _score_few(codes, starts, sizes, left, right, symbols: int, width: int) -> np.ndarray:
    """The same recurrence on whole integers, pair by pair: faster than stepping
    through arrays that hold only a few pairs."""
    out = np.empty(len(left))
    held, masks, full = -1, {}, 0
    rights = {int(r): codes[starts[r] : starts[r] + sizes[r]].tolist() for r in np.unique(right)}
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        if a != held:
            held, masks, full = a, {}, (1 << int(sizes[a])) - 1
            for bit, c in enumerate(codes[starts[a] : starts[a] + sizes[a]].tolist()):
                masks[c] = masks.get(c, 0) | (1 << bit)
        state = full
        for c in rights[b]:
            seen = state & masks.get(c, 0)
            if seen:
                state = ((state + seen) | (state - seen)) & full
        out[k] = int(sizes[a]) - state.bit_count()
    return out


def _score_chunk(codes, starts, sizes, left, right, symbols: int, width: int) -> np.ndarray:
    who, slot = np.unique(left, return_inverse=True)
    table = np.zeros((width, len(who) * symbols), dtype=np.uint64)
    for k, s in enumerate(who):
        own = codes[starts[s] : starts[s] + sizes[s]]
        bits = np.arange(len(own))
        np.bitwise_or.at(
            table,
            (bits // 64, k * symbols + own),
            np.uint64(1) << (bits % 64).astype(np.uint64),
        )
    # Longest right sequences first: the active pairs are always a prefix.
    order = np.argsort(-sizes[right], kind="stable")
    slot, far, near = slot[order], starts[right][order], sizes[right][order]
    state = np.full((width, len(order)), ~np.uint64(0), dtype=np.uint64)
    base = slot * symbols
    active = len(order)
    for step in range(int(near[0]) if len(near) else 0):
        active = int(np.searchsorted(-near, -step, side="left"))
        if active == 0:
            break
        column = base[:active] + codes[far[:active] + step]
        carry = None
        for w in range(width):
            v = state[w, :active]
            u = v & table[w, column]
            total = v + u
            over = total < v
            if carry is not None:
                bumped = total + carry
                over = over | (bumped < total)
                total = bumped
            state[w, :active] = total | (v - u)
            carry = over.astype(np.uint64)
    # Positions of the left sequence whose bit went to zero are matched.
    matched = np.zeros(len(order))
    lengths = sizes[left][order]
    for w in range(width):
        valid = np.clip(lengths - 64 * w, 0, 64)
        mask = np.where(valid >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(valid, 63).astype(np.uint64)) - np.uint64(1))
        matched += np.bitwise_count(~state[w] & mask)
    out = np.empty(len(order))
    out[order] = matched
    return out


def _align(codes, starts, sizes, left, right, scores: tuple[float, float, float]) -> np.ndarray:
    """Global alignment score of many pairs with arbitrary scores."""
    match, mismatch, gap = scores
    out = np.zeros(len(left))
    step = max(1, TABLE_BYTES // (8 * 4 * (int(sizes.max(initial=0)) + 1)))
    for at in range(0, len(left), step):
        a, b = left[at : at + step], right[at : at + step]
        la, lb = sizes[a], sizes[b]
        n, m = int(la.max(initial=0)), int(lb.max(initial=0))
        rows = np.arange(len(a))
        line = np.tile(gap * np.arange(m + 1), (len(a), 1))
        ends = line[rows, lb] * (la == 0)
        for i in range(1, n + 1):
            x = codes[np.minimum(starts[a] + i - 1, len(codes) - 1)]
            new = np.empty_like(line)
            new[:, 0] = gap * i
            for j in range(1, m + 1):
                y = codes[np.minimum(starts[b] + j - 1, len(codes) - 1)]
                diagonal = line[:, j - 1] + np.where(x == y, match, mismatch)
                new[:, j] = np.maximum(np.maximum(diagonal, line[:, j] + gap), new[:, j - 1] + gap)
            line = new
            ends = np.where(la == i, line[rows, lb], ends)
        # An empty sequence scores zero by definition.
        out[at : at + step] = np.where((la == 0) | (lb == 0), 0.0, ends)
    return out


def _encode(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integer codes, starts and sizes of a list<string> array."""
    offsets = column.offsets.to_numpy()
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, (offsets[:-1] - offsets[0]).astype(np.int64), np.diff(offsets).astype(np.int64)


def score_pairs(a: pa.ListArray, b: pa.ListArray, scores=LCS) -> np.ndarray:
    """Alignment score of the i-th sequence of ``a`` with the i-th of ``b``."""
    both = pa.concat_arrays([a, b])
    codes, starts, sizes = _encode(both)
    left, right = np.arange(len(a)), np.arange(len(a), len(a) + len(b))
    if scores == LCS:
        return _common_lengths(codes, starts, sizes, left, right)
    return _align(codes, starts, sizes, left, right, scores)


def _row_sums(batch: pa.RecordBatch, a: str, b: str | None, scores) -> tuple[list[int], list[np.ndarray]]:
    """Weighted alignment scores summed per sequence, for all rows of a batch.

    With ``b`` absent a row is compared with itself, different sequences only.
    The pairs of all rows are scored together, in bounded slices.
    """
    lists = [batch.column(c) for c in ([a] if b is None else [a, b])]
    counts = [batch.column("ca")] if b is None else [batch.column("ca"), batch.column("cb")]
    bounds = [c.offsets.to_numpy() for c in lists]
    inner = [c.values for c in lists]
    pieces = [v.slice(o[0], o[-1] - o[0]) for v, o in zip(inner, bounds, strict=True)]
    codes, starts, sizes = _encode(pa.concat_arrays(pieces) if len(pieces) > 1 else pieces[0])
    weights = [_flat(c) for c in counts]
    shift = [0, len(pieces[0])]
    weight = np.concatenate(weights)
    total = np.zeros(len(weight))
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if not pending:
            return
        left = np.concatenate([p[0] for p in pending])
        right = np.concatenate([p[1] for p in pending])
        # The shorter sequence of a pair holds the bits.
        swap = sizes[left] > sizes[right]
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        found = (
            _common_lengths(codes, starts, sizes, left, right)
            if scores == LCS
            else _align(codes, starts, sizes, left, right, scores)
        )
        np.add.at(total, left, weight[right] * found)
        np.add.at(total, right, weight[left] * found)
        pending.clear()
        held = 0

    spans = []
    for r in range(batch.num_rows):
        lo, hi = int(bounds[0][r] - bounds[0][0]), int(bounds[0][r + 1] - bounds[0][0])
        if b is None:
            i, j = np.triu_indices(hi - lo, 1)
            pending.append((lo + i, lo + j))
            spans.append([(lo, hi)])
        else:
            lo2 = int(bounds[1][r] - bounds[1][0]) + shift[1]
            hi2 = int(bounds[1][r + 1] - bounds[1][0]) + shift[1]
            i, j = np.meshgrid(np.arange(lo, hi), np.arange(lo2, hi2), indexing="ij")
            pending.append((i.ravel(), j.ravel()))
            spans.append([(lo, hi), (lo2, hi2)])
        held += len(pending[-1][0])
        if held > HELD:
            settle()
    settle()
    rows = [r for r, s in enumerate(spans) for _ in s]
    return rows, [total[lo:hi] for s in spans for lo, hi in s]


def _flat(column: pa.ListArray) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64)


def distinct_sums(
    counted: DataFrame, keys: list[str], feature: str, whole, own, cross, height: int = HEIGHT,
    order: Column | None = None, skip=None, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """``keys..., n, feature, cnt, other`` over the distinct features of each group.

    The kernels return per feature the count-weighted sum of its scores against the
    *other* features: ``whole`` and ``own`` within one block (of a group that is one
    block, and of one that has several), ``cross`` between two blocks. With ``order``,
    blocks hold features that follow each other in it, and ``skip`` rules out pairs of
    blocks by the columns ``extra`` (expressions over ``rows``).
    """
    if order is None:
        small, large = bl.packed(counted, keys, None, [feature, "cnt"], height, count="cnt")
    else:
        placed = ordinal(counted.withColumn("_order", order), keys, ["_order", feature], "_pos")
        placed = placed.withColumn("_blk", F.floor(F.col("_pos") / F.lit(height)).cast("int"))
        small, large = bl.split(cut_lineage(bl.gather(placed, keys, None, [feature, "cnt"], height, "_blk", count="cnt")))
    a, ca = F.col(f"rows.{feature}").alias("a"), F.col("rows.cnt").alias("ca")
    parts = []
    if small is not None:
        parts.append(bl.run_rows(small, keys, [feature, "cnt"], whole, [a, ca]))
    if large is not None:
        single = bl.run(large.select(*keys, "blk", a, ca), keys, own)
        sides = {"a": F.col(f"rows.{feature}"), "ca": F.col("rows.cnt")}, {"b": F.col(f"rows.{feature}"), "cb": F.col("rows.cnt")}
        blocks = large.withColumns(extra or {})
        double = tiles.tile_sums(blocks, keys, *sides, cross, skip, list(extra or {}))
        sums = bl.add_up(single.unionByName(double), [*keys, "blk"])
        parts.append(bl.unpack(large, sums, keys, [feature, "cnt"]))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("sum", "other")


def counted_mass(self_score: Column, other: Column) -> list[Column]:
    """``p`` and ``zp`` of a feature held by ``cnt`` of ``n`` species.

    The species itself counts one, its copies ``self_score`` each, and ``other`` is
    the weighted similarity to all other features.
    """
    zp = (F.lit(1.0) + (F.col("cnt") - 1) * self_score + other) / F.col("n")
    return [(F.col("cnt") / F.col("n")).alias("p"), zp.alias("zp")]


def _kernels(scores):
    def whole(batch):
        return _row_sums(batch, "a", None, scores)[1]

    def own(batch):
        rows, arrays = _row_sums(batch, "a", None, scores)
        return rows, batch.column("blk").to_pylist(), arrays

    def cross(batch):
        rows, arrays = _row_sums(batch, "a", "b", scores)
        left, right = batch.column("i").to_pylist(), batch.column("j").to_pylist()
        blk = [b for pair in zip(left, right, strict=True) for b in pair]
        return rows, blk, arrays

    return whole, own, cross


def similarity_mass(
    df: DataFrame,
    by: Sequence[str] = (),
    seq: str = "tags",
    scores: tuple[float, float, float] = LCS,
    valid: Column | None = None,
) -> DataFrame:
    """``by..., seq, cnt, p, zp, valid``: one row per distinct sequence of a group.

    Similarity is the alignment score over the longest sequence of the group.
    """
    src, keys = keyed(df, by)
    rows = src.select(*keys, F.col(seq).alias("_f"), (valid if valid is not None else F.lit(True)).alias("valid"))
    # What makes the sequences may cost more than all that follows, which reads them several times.
    held = cut_lineage(rows.groupBy(*keys, "_f").agg(F.count("*").alias("cnt"), F.min("valid").alias("valid")))
    counted = held.where(F.col("_f").isNotNull()).drop("valid")
    longest = counted.groupBy(*keys).agg(F.greatest(F.max(F.size("_f")), F.lit(1)).alias("_len"))
    kernels = _kernels(tuple(float(s) for s in scores))
    sums = distinct_sums(counted, keys, "_f", *kernels).join(longest, keys)
    self_score = F.lit(float(scores[0])) * F.size("_f") / F.col("_len")
    raw = sums.select(*keys, "_f", "cnt", *counted_mass(self_score, F.col("other") / F.col("_len")))
    flags = held.groupBy(*keys).agg(F.min("valid").alias("valid"))
    nothing = F.lit(None).cast("double")
    marks = flags.select(
        *keys, F.lit(None).cast("array<string>").alias("_f"), F.lit(0).cast("bigint").alias("cnt"),
        nothing.alias("p"), nothing.alias("zp"), "valid",
    )
    out = raw.withColumn("valid", F.lit(True)).unionByName(marks)
    return unkeyed(by, out.withColumnRenamed("_f", seq))


def sequence_diversity(
    df: DataFrame,
    by: Sequence[str] = (),
    seq: str = "tags",
    q: float = 1.0,
    normalize: bool = False,
    pad: str | None = None,
    scores: tuple[float, float, float] = LCS,
    valid: Column | None = None,
    metric_name: str = "pos_sequence",
) -> DataFrame:
    """Diversity with one species per row, compared by sequence alignment.

    ``pad`` fills every sequence to the longest of its group with that symbol.
    """
    if pad is not None:
        df = pad_to_longest(df, by, seq, pad)
    return hill.diversity(similarity_mass(df, by, seq, scores, valid), by, q, normalize, metric_name)


def pad_to_longest(df: DataFrame, by: Sequence[str], seq: str, symbol: str) -> DataFrame:
    """Fill the sequences of a group to equal length."""
    src, keys = keyed(df, by)
    longest = src.groupBy(*keys).agg(F.max(F.size(seq)).alias("_len"))
    missing = F.col("_len") - F.size(seq)
    padded = F.concat(F.col(seq), F.array_repeat(F.lit(symbol), missing))
    return unkeyed(by, src.join(longest, keys).withColumn(seq, padded).drop("_len"))


def _character(code: Column) -> Column:
    """The character of a code point, surrogates skipped: its bytes in UTF-32."""
    point = F.when(code < 0xD800, code).otherwise(code + 0x800)
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def tags_to_symbols(df: DataFrame, by: Sequence[str], id: str, seq: str) -> DataFrame:
    """``by..., id, symbols``: every tag as one character, from ``A`` upwards in the
    alphabetical order of the group's distinct tags."""
    src, keys = keyed(df, by)
    tags = src.select(*keys, id, F.posexplode(seq).alias("_i", "tag"))
    # One row per distinct tag of a group: the dictionary, not the data, is ranked.
    distinct = tags.select(*keys, "tag").distinct()
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("tag"))
    names = distinct.withColumn("symbol", _character(F.lit(64) + rank))
    joined = tags.join(names, [*keys, "tag"])
    ordered = F.array_sort(F.collect_list(F.struct("_i", "symbol")))
    strings = joined.groupBy(*keys, id).agg(F.array_join(ordered["symbol"], "").alias("symbols"))
    # Documents without tags keep an empty string.
    out = src.select(*keys, id).join(strings, [*keys, id], "left")
    return unkeyed(by, out.withColumn("symbols", F.coalesce("symbols", F.lit(""))))


def alignment_score(a: str, b: str, scores: tuple[float, float, float] = LCS) -> Column:
    """Alignment score of two ``ARRAY<STRING>`` columns, in Arrow batches."""
    fixed = tuple(float(s) for s in scores)

    @F.arrow_udf("double")
    def score(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in parts:
            yield pa.array(score_pairs(left, right, fixed), pa.float64())

    return score(F.col(a), F.col(b))


def rank_sequences(
    queries: DataFrame,
    corpus: DataFrame,
    seq: str,
    k: int = 1,
    query_id: str = "query_id",
    id: str = "doc_id",
    scores: tuple[float, float, float] = LCS,
) -> DataFrame:
    """Rank documents by alignment with each query; the score is over the longer of
    the two sequences. See :func:`effnum.operators.ranking.top_k`."""
    from .ranking import against_queries, top_k

    scored = against_queries(queries, corpus, seq, query_id, id)
    longer = F.greatest(F.size("_q"), F.size("_c"))
    value = F.coalesce(F.try_divide(F.col("_raw"), longer), F.lit(0.0))
    rows = scored.withColumn("_raw", alignment_score("_q", "_c", scores))
    return top_k(rows.select("query_id", "id", value.alias("score")), k)
