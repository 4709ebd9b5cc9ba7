"""Near duplicates: documents linked by the Jaccard similarity of their word shingles.

Candidates come from PartEnum signatures. Sets are put into bands of nearly equal size.
Two sets of similarity 0.8 differ in at most a quarter of the smaller one, k elements for
a band. The hashed domain is cut into partitions, somewhat more than half of k; at least
one of them holds at most one of the differing elements, so of its three cells two hold
the same elements in both sets. A set's signatures are the contents of all pairs of cells
of all partitions, for its own band and for the band below (where it may be the larger
partner). Small sets use more than k partitions of one cell each, of which one agrees
(three cells would often be empty). Similar sets always share a signature; what shares
one is then compared exactly.

Equal sets are one set with many documents from the start, so exact copies cost nothing
further. No pairs of a bucket are written out: first every set is compared with the
smallest set of one of its buckets (a star), which joins almost every group at once.
Buckets that then still lie in different components are compared block by block in
tasks, only across components, by counts of elements that bound the difference from
below; what passes is compared exactly, so no component is missed. The links themselves lie
inside the components: there all sets near enough in size are compared exactly, block by
block, and counted (or written out, ``exact_links``). Links, components and sets stay in
DataFrames; what goes to the driver is counts and a bit filter of fixed size that only
saves work.

Sets and signatures are 64-bit hashes (distinct shingles of one document that collide
are counted once; two of 3 * 10**10 different sets fall together with an expectation of
a few dozen in all).

Defined cases: a text without words, empty or null, has an empty set, is linked with
nothing and is a component by itself; a text of fewer than five words is one shingle of
them all; rows with the same id are rows of their own, in the result too; a null id never
names a component unless no other id is there; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, cut_lineage, release
from .common import WORD, flat, mixed, row_groups, words_in
from .vectors import packed

SHINGLE = 5
SHARE = (80, 100)  # intersection by union
PIECE = 1 << 20  # bytes hashed at a time
CELLS = 256  # ranges of the hashed domain in which elements are counted
BLOCK = 64  # sets of a block in the comparison across components
HEIGHT = 2048  # sets of a block in the comparison inside components
BYTES = 1 << 22  # bytes of such a block
COLUMNS = 4096  # elements (with the same sets) that are compared at a time
KNOWN = 1 << 17  # pairs that a task remembers, so as not to write them again
FILTER_BITS = 1 << 26
ENUMERATED = 48  # differing elements from which on subsets of cells are enumerated
SECOND = 3  # cells of a partition then; a signature leaves one of them out

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RIM = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def bands(largest: int) -> np.ndarray:
    """Smallest sizes of the bands; a band ends where a similarity of 0.8 to its first size ends."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * SHARE[1] // SHARE[0] + 1)
    return np.array(out, np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all rows, in order, and each row's offsets among them."""
    parts, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for a, b in row_groups(offsets, PIECE):
        at, stop = int(offsets[a]), int(offsets[b])
        while at < stop:
            end = stop
            if b - a == 1 and stop - at > PIECE:  # a long row: cut at white space
                end = at + PIECE
                while end < stop and not _RIM[data[end]]:
                    end += 1
            own = np.clip(offsets[a : b + 1], at, end) - at
            n = len(own) - 1
            text = np.full(end - at + n + 1, 32, np.uint8)
            text[np.arange(end - at) + np.repeat(np.arange(1, n + 1), np.diff(own))] = _LOWER[data[at:end]]
            start, _, word = words_in(text, _RIM[text])
            row = np.searchsorted(own + np.arange(n + 1), start, side="right") - 1
            parts.append(word)
            counts[a:b] += np.bincount(row, minlength=n)[:n]
            at = end
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles as sorted 64-bit numbers, one after the other, and the rows' offsets."""
    word, edges = word_hashes(data, offsets)
    sizes = np.diff(edges)
    odd = np.uint64(0xD1342543DE82EF95)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    parts, rows = [], []
    if len(word) >= SHINGLE:
        roll = word[: len(word) - SHINGLE + 1].copy()
        for j in range(1, SHINGLE):
            roll = roll * odd + word[j : len(word) - SHINGLE + 1 + j]
        whole = row_of[: len(roll)] == row_of[SHINGLE - 1 :]
        parts.append(mixed(roll[whole]))
        rows.append(row_of[: len(roll)][whole])
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        roll = np.zeros(len(short), np.uint64)
        for j in range(SHINGLE - 1):
            inside = sizes[short] > j
            roll[inside] = roll[inside] * odd + word[edges[short[inside]] + j]
        parts.append(mixed(roll + sizes[short].astype(np.uint64)))
        rows.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64)
    h, r = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[first], r[first]
    return h, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(sizes)))])


def set_ids(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One number for each set; empty sets get 0."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h ^ np.uint64(0x5851F42D4C957F2D)))])
    n = np.diff(edges)
    return np.where(n > 0, mixed(total[edges[1:]] - total[edges[:-1]] + n.astype(np.uint64)), 0).view(np.int64)


def parameters(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partitions of the domain, and cells of a partition, for sets that differ in ``k`` elements.

    Large sets: in more than half of k partitions, one has at most one different element, hence all
    but one of its cells agree. Small sets: in more than k partitions of one cell, one agrees. There
    are a few more partitions than that, so that those with too few elements can be left out.
    """
    few = k // 2 + 1
    spare = np.ceil(0.05 * few + 5 * np.sqrt(0.05 * few)).astype(np.int64)
    large = k >= ENUMERATED
    return np.where(large, few + spare, np.where(k == 0, 1, k + 1 + (k + 1) * 12 // 100 + 4)), np.where(large, SECOND, 1)


def signatures(h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets (sorted 64-bit numbers): the signatures and the rows they belong to.

    A partition is a range of the hashed domain and its cells are equal parts of it, so both are runs
    of a sorted set. A signature stands for all cells of a partition but one (for the only one, where
    a partition has a single cell).
    """
    n = np.diff(edges)
    rows = np.flatnonzero(n)
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = bands(int(n.max()))
    band = np.searchsorted(low, n[rows], side="right") - 1
    row_of = np.repeat(np.arange(len(n)), n)
    value = mixed(h + np.uint64(0x9E3779B97F4A7C15))
    run = np.concatenate([[np.uint64(0)], np.cumsum(value)])
    out, owner = [], []

    def emit(sums, names, rows_of):
        out.append(mixed(sums + mixed(names)))
        owner.append(rows_of)

    for below in (0, 1):
        use = rows[band >= below]
        inst = band[band >= below] - below
        if not len(use):
            continue
        upper = low[inst + 1] - 1  # largest size of the smaller partner
        k = upper * (SHARE[1] - SHARE[0]) // SHARE[0]  # how many elements similar sets differ in
        first, second = parameters(k)
        spread = lambda x, to=use: np.bincount(to, x, len(n)).astype(np.int64)
        cells_of, second_of, name_of = spread(first * second), spread(second), spread(inst).astype(np.uint64) << np.uint64(44)
        c = cells_of[row_of]
        live = c > 0
        # Cells are equal ranges of the hashed domain, so a sorted set's cells are runs.
        cell = (((h >> np.uint64(32)) * c.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        change = np.ones(len(h), bool)
        change[1:] = (cell[1:] != cell[:-1]) | (row_of[1:] != row_of[:-1])
        bounds = np.append(np.flatnonzero(change), len(h))
        start, stop = bounds[:-1][live[bounds[:-1]]], bounds[1:][live[bounds[:-1]]]
        r, at, sums = row_of[start], cell[start], run[stop] - run[start]
        part = at // np.maximum(second_of[r], 1)
        single = second_of[r] == 1
        # One cell a partition: its content.
        emit(sums[single], name_of[r[single]] + part[single].astype(np.uint64) * np.uint64(4) + np.uint64(3), r[single])
        # Several: the partition without each cell in turn, as long as something is left.
        r, at, sums, part = r[~single], at[~single], sums[~single], part[~single]
        edge = np.ones(len(r), bool)
        edge[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(edge) - 1
        heads = np.flatnonzero(edge)
        total = np.add.reduceat(sums, heads) if len(heads) else np.zeros(0, np.uint64)
        filled = np.bincount(group, minlength=len(heads))
        parted = name_of[r[heads]] + part[heads].astype(np.uint64) * np.uint64(4)
        for left_out in range(SECOND):
            here = (at % SECOND) == left_out
            without = total.copy()
            without[group[here]] -= sums[here]
            rest = filled.copy()
            rest[group[here]] -= 1
            some = rest > 0
            emit(without[some], parted[some] + np.uint64(left_out), r[heads][some])
        # Where too few partitions are filled, those that agree may be empty: then what is empty counts too.
        useful = np.bincount(row_of[start][single], minlength=len(n)) + np.bincount(r[heads][filled > 1], minlength=len(n))
        for row, i, kk, n1, n2 in zip(use, inst, k, first, second):
            if useful[row] <= (kk if n2 == 1 else kk // 2):
                have = cell[edges[row] : edges[row + 1]]
                codes = np.arange(n1) * 4 + 3 if n2 == 1 else (np.arange(n1)[:, None] * 4 + np.arange(n2)).ravel()
                if n2 == 1:
                    gone = ~np.isin(np.arange(n1), have)
                else:
                    inside = np.zeros((n1, n2), np.int64)
                    np.add.at(inside, (have // n2, have % n2), 1)
                    gone = (inside.sum(1)[:, None] == inside).ravel()
                free = (np.uint64(i) << np.uint64(44)) + codes[gone].astype(np.uint64)
                out.append(mixed(free) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                owner.append(np.full(len(free), row))
    return np.concatenate(out), np.concatenate(owner)


def _groups(column: pa.Array):
    """Rows of a batch in groups of bounded size: first row, sets and their offsets."""
    data, offsets = flat(column)
    for a, b in row_groups(offsets, 4 * PIECE):
        yield a, shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _row_key(doc_id: str, text: str, d: str, t: str) -> list[Column]:
    """What tells rows apart: the id and the hash of the text."""
    return [F.col(doc_id).cast("long").alias(d), F.xxhash64(text).alias(t)]


def document_sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``d, t, s, n, k``: id, hash of the text, set and number of shingles of every document, and how
    many of them lie in each of ``CELLS`` equal ranges of the hashed domain (up to 255)."""
    rows = docs.select(*_row_key(doc_id, text, "d", "t"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            s, n, k = [], [], []
            for _, (h, edges) in _groups(b.column(2)):
                s.append(set_ids(h, edges))
                n.append(np.diff(edges))
                cell = np.repeat(np.arange(len(n[-1])), n[-1]) * CELLS + (h >> np.uint64(56)).astype(np.int64)
                counts = np.minimum(np.bincount(cell, minlength=len(n[-1]) * CELLS), 255).astype(np.uint8)
                k += [c.tobytes() for c in counts.reshape(-1, CELLS)]
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cat(s)), pa.array(cat(n)), pa.array(k, pa.binary())], ["d", "t", "s", "n", "k"]
            )

    return rows.mapInArrow(run, "d long, t long, s long, n long, k binary")


def signature_rows(docs: DataFrame, text: str) -> DataFrame:
    """``g, s``: signatures and the sets they belong to, equal sets of a group of rows once."""

    def run(batches):
        for b in batches:
            for _, (h, edges) in _groups(b.column(0)):
                s = set_ids(h, edges)
                first = np.zeros(len(s), bool)
                first[np.unique(s, return_index=True)[1]] = True
                keep = np.repeat(first, np.diff(edges))
                sizes = np.where(first, np.diff(edges), 0)
                g, owner = signatures(h[keep], np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(s[owner])], ["g", "s"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "g long, s long")


def _packed_sets(docs: DataFrame, text: str, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``s, h``: the sets of ``wanted`` (column s) as sorted packed numbers.

    One text of every set is hashed again (``rows``: the hash t of the texts with a set s). A bit
    filter of the texts' hashes lets a task leave out most other texts; the join drops the rest.
    """
    spark = SparkSession.active()
    texts = rows.join(wanted.select("s"), "s", "left_semi").groupBy("s").agg(F.min("t").alias("t"))
    # Spark counts bits from one.
    got = texts.select((F.pmod(F.col("t"), F.lit(FILTER_BITS)) + 1).alias("x"))
    place = (
        got.groupBy(F.bitmap_bucket_number("x").alias("k"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
        .collect()  # FILTER_BITS bits at most, whatever the corpus
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in place:
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def run(batches):
        held = shared.value
        for b in batches:
            t, once = np.unique(b.column(0).to_numpy(), return_index=True)
            x = t % FILTER_BITS
            near = (held[x >> 3] >> (x & 7).astype(np.uint8)) & 1
            for _, (h, edges) in _groups(b.column(1).take(pa.array(np.sort(once[near > 0])))):
                s = set_ids(h, edges)
                first = np.zeros(len(s), bool)
                first[np.unique(s, return_index=True)[1]] = True
                at = np.flatnonzero(first & (np.diff(edges) > 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s[at]), pa.array([h[edges[i] : edges[i + 1]].tobytes() for i in at], pa.binary())], ["s", "h"]
                )

    found = docs.select(F.xxhash64(text).alias("t"), F.col(text).alias("text")).mapInArrow(run, "s long, h binary")
    return found.join(wanted.select("s"), "s", "left_semi").dropDuplicates(["s"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) * SHARE[1] < len(large) * SHARE[0]:
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both * SHARE[1] >= (len(a) + len(b) - both) * SHARE[0]


def _near(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (with a, b) that may be similar by the cell counts (s, n, k)."""
    side = lambda x: counts.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("k").alias(f"k{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(*pairs.columns, "na", "nb", "ka", "kb")
    own = pairs.columns

    def run(batches):
        for batch in batches:
            get = lambda n: batch.column(n).to_numpy()  # noqa: B023, E731
            ka, kb = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for n in ("ka", "kb"))
            keep = may_link(np.abs(ka - kb).sum(1, dtype=np.int64), get("na") + get("nb"))
            yield batch.select(own).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, pairs.schema)


def may_link(apart: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Similar sets differ in at most this share of both sizes together."""
    return apart * (SHARE[0] + SHARE[1]) <= sizes * (SHARE[1] - SHARE[0])


def _linked(pairs: DataFrame, docs: DataFrame, text: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of ``pairs`` (a, b) whose sets are similar, and the sets (s, h); their texts are hashed again for it."""
    ends = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct()
    sets = cut_lineage(_packed_sets(docs, text, rows, ends))
    left = sets.select(F.col("s").alias("a"), F.col("h").alias("ha"))
    right = sets.select(F.col("s").alias("b"), F.col("h").alias("hb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ha", "hb")

    def run(batches):
        for batch in batches:
            keep = [
                similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64))
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut_lineage(both.mapInArrow(run, "a long, b long")), sets


def components(links: DataFrame) -> DataFrame:
    """``s, c``: the smallest set reachable by ``links`` (a, b), for every linked set.

    Smallest labels go along links and along labels at once, so long chains end in a
    logarithmic number of rounds; each round is written to the checkpoint folder.
    """
    both = cut_lineage(links.union(links.select("b", "a")).distinct())
    label = cut_lineage(both.groupBy(F.col("a").alias("s")).agg(F.least(F.col("s"), F.min("b")).alias("c")))
    while True:
        near = both.join(label.select(F.col("s").alias("b"), "c"), "b").groupBy(F.col("a").alias("s")).agg(F.min("c").alias("m"))
        low = label.join(near, "s").select("s", F.col("c").alias("old"), F.least("c", "m").alias("t"))
        up = label.select(F.col("s").alias("t"), F.col("c").alias("u"))
        new = cut_lineage(low.join(up, "t").select("s", "old", F.least("t", "u").alias("c")))
        done = new.where(F.col("c") != F.col("old")).isEmpty()
        label = new.select("s", "c")
        del near, low, up, new
        release(links.sparkSession)  # what the round left behind, here and on the driver
        if done:
            return label


def _open(live: DataFrame, found: DataFrame) -> DataFrame:
    """``g, s, c, lead`` of the buckets of ``live`` (g, s) that hold several components still.

    Buckets with the same members are kept once.
    """
    own = live.select("g", "s").join(found, "s", "left").select("g", "s", F.coalesce("c", "s").alias("c"))
    bucket = (
        own.groupBy("g")
        .agg(
            F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("s").alias("lead"), F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("s")).alias("x"), F.bit_xor(F.xxhash64("s", F.lit(1))).alias("y"),
        )
        .where(F.col("lo") != F.col("hi"))
    )
    once = bucket.groupBy("x", "y", "n").agg(F.min("g").alias("g"), F.first("lead").alias("lead"))
    return cut_lineage(own.join(once.select("g", "lead"), "g"))


def _across(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in different components of one bucket (g, s, c) that may be similar, once."""
    return _candidates(rows, counts).distinct()


def _candidates(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The pairs of :func:`_across`, each about once a task.

    Buckets are cut into blocks, and blocks are compared with blocks by their cell counts:
    two sets differ in at least as many elements as their counts do, so nothing similar
    is left out, and little else is let through. Two sets often meet in hundreds of buckets:
    a task remembers the pairs it has written.
    """

    def block(batches):
        for (g,), t in packed(batches, ("g",), BLOCK):
            get = lambda n: t.column(n).to_numpy()  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array([g]), pa.array([t.column("s")[0].as_py()]), pa.array([int(get("c")[0])]), pa.array([int(get("c")[-1])]),
                 *[pa.array([get(x).tobytes()], pa.binary()) for x in ("s", "c", "n")],
                 pa.array([b"".join(t.column("k").to_pylist())], pa.binary())],
                ["g", "at", "lo", "hi", "ss", "cs", "ns", "ks"],
            )

    blocks = cut_lineage(
        rows.select("g", "s", "c").join(counts, "s")
        .repartitionByRange("g", "c", "s")
        .sortWithinPartitions("g", "c", "s")
        .select("g", "s", "c", "n", "k")
        .mapInArrow(block, "g long, at long, lo long, hi long, ss binary, cs binary, ns binary, ks binary")
    )
    names = ("ss", "cs", "ns", "ks")
    left = blocks.withColumnsRenamed({x: f"{x}1" for x in ("at", "lo", "hi", *names)})
    same = (F.col("lo1") == F.col("hi1")) & (F.col("lo") == F.col("hi")) & (F.col("lo1") == F.col("lo"))
    # Blocks are ordered by component and set, so each pair of blocks comes once.
    order = (F.col("lo1") < F.col("lo")) | ((F.col("lo1") == F.col("lo")) & (F.col("at1") <= F.col("at")))
    pairs = left.join(blocks, "g").where(order & ~same).select(*[f"{x}1" for x in names], *names)

    def run(batches):
        known: set[tuple[int, int]] = set()
        for b in batches:
            new: set[tuple[int, int]] = set()
            for r in range(b.num_rows):
                s1, c1, n1, s2, c2, n2 = (np.frombuffer(b.column(n)[r].as_py(), np.int64) for n in ("ss1", "cs1", "ns1", *names[:3]))
                k1, k2 = (np.frombuffer(b.column(n)[r].as_py(), np.uint8).reshape(-1, CELLS).astype(np.int16) for n in ("ks1", "ks"))
                apart = np.abs(k1[:, None] - k2[None]).sum(2, dtype=np.int64)
                i, j = np.nonzero(may_link(apart, n1[:, None] + n2[None]) & (c1[:, None] != c2[None]))
                new.update(zip(np.maximum(s1[i], s2[j]).tolist(), np.minimum(s1[i], s2[j]).tolist()))
            new -= known
            if len(known) + len(new) > KNOWN:
                known = set()
            known |= new
            both = np.array(list(new), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def overlaps(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many elements each set of ``x`` shares with each of ``y`` (elements one after the other, offsets).

    Elements in the same sets count as one column with a weight, so near copies have few columns.
    """
    (hx, ex), (hy, ey) = x, y
    nx, n = len(ex) - 1, len(ex) + len(ey) - 2
    row = np.repeat(np.arange(n), np.concatenate([np.diff(ex), np.diff(ey)]))
    _, at, many = np.unique(np.concatenate([hx, hy]), return_inverse=True, return_counts=True)
    row, at = row[many[at] > 1], at[many[at] > 1]
    order = np.lexsort((row, at))
    row, at = row[order], at[order]
    start = np.flatnonzero(np.diff(at, prepend=-1))
    held: dict[bytes, list[int]] = {}
    for a, z in zip(start.tolist(), [*start[1:].tolist(), len(row)]):
        held.setdefault(row[a:z].tobytes(), [0, a, z])[0] += 1
    out = np.zeros((nx, n - nx))
    columns = list(held.values())
    for lo in range(0, len(columns), COLUMNS):
        own = columns[lo : lo + COLUMNS]
        inside = np.zeros((n, len(own)), np.float32)
        for j, (_, a, z) in enumerate(own):
            inside[row[a:z], j] = 1
        weight = np.array([w for w, _, _ in own], np.float32)
        out += (inside[:nx] * weight) @ inside[nx:].T
    return out


def _similar_sets(x: tuple, y: tuple) -> np.ndarray:
    both = overlaps(x, y)
    return both * SHARE[1] >= (np.diff(x[1])[:, None] + np.diff(y[1])[None, :] - both) * SHARE[0]


def _all_links(found: DataFrame, sets: DataFrame, weights: DataFrame, pairs: bool = False) -> DataFrame:
    """All exact links between different sets: ``a, b`` with a < b, or ``s, m``, the documents linked with each set.

    Links lie inside components (``found``: s, c). A component's sets (s, h) are cut by size into
    blocks of bounded bytes; blocks are compared in themselves and with those that are near enough
    in size, each pair of sets once. Without ``pairs`` only sums (of ``weights``: s, w) leave a task.
    """
    members = found.join(sets, "s").join(weights, "s").withColumn("n", F.length("h") / 8)
    names = ("ss", "ns", "ws", "hs")
    shape = "c long, at long, lo long, hi long, ss binary, ns binary, ws binary, hs binary"

    def pack(batches):
        held, now, size = [], None, 0

        def block():
            s, n, w, h = (list(x) for x in zip(*held))
            cells = [b"".join(h) if k == 3 else np.array(x, np.int64).tobytes() for k, x in enumerate((s, n, w, h))]
            return pa.RecordBatch.from_arrays(
                [*(pa.array([int(x)]) for x in (now, s[0], n[0], n[-1])), *(pa.array([x], pa.binary()) for x in cells)],
                ["c", "at", "lo", "hi", *names],
            )

        for b in batches:
            for c, *row in zip(*(b.column(x).to_pylist() for x in ("c", "s", "n", "w", "h"))):
                if held and (c != now or len(held) == HEIGHT or size + len(row[3]) > BYTES):
                    yield block()
                    held, size = [], 0
                now = c
                held.append(row)
                size += len(row[3])
        if held:
            yield block()

    blocks = cut_lineage(
        members.select("c", F.col("n").cast("long").alias("n"), "s", "w", "h")
        .repartitionByRange("c", "n", "s")
        .sortWithinPartitions("c", "n", "s")
        .mapInArrow(pack, shape)
    )

    def compare(batches):
        """Links of one block in itself, or with another one where its columns are there."""
        for b in batches:
            for r in range(b.num_rows):
                get = lambda n, t=np.int64: np.frombuffer(b.column(n)[r].as_py(), t)  # noqa: B023, E731
                side = lambda p: (get(f"hs{p}", np.uint64), np.concatenate([[0], np.cumsum(get(f"ns{p}"))]))  # noqa: B023, E731
                other = "1" if "ss1" in b.schema.names else ""
                near = _similar_sets(side(other), side(""))
                x, y = get(f"ss{other}"), get("ss")
                if not other:
                    near = np.triu(near, 1)
                if pairs:
                    i, j = np.nonzero(near)
                    out = [np.minimum(x[i], y[j]), np.maximum(x[i], y[j])]
                else:
                    sums = np.concatenate([near @ get("ws"), get(f"ws{other}") @ near])
                    out = [np.concatenate([x, y])[sums > 0], sums[sums > 0]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], ["a", "b"] if pairs else ["s", "m"])

    kind = "a long, b long" if pairs else "s long, m long"
    heads = blocks.select("c", "at", "lo", "hi")
    # Blocks of a component follow each other by size.
    ahead = F.struct("lo1", "at1") < F.struct("lo", "at")
    beside = heads.withColumnsRenamed({"at": "at1", "lo": "lo1", "hi": "hi1"}).join(heads, "c")
    beside = beside.where(ahead & (F.col("lo") * SHARE[0] <= F.col("hi1") * SHARE[1])).select("at1", "at")
    first = blocks.select(F.col("at").alias("at1"), *(F.col(x).alias(f"{x}1") for x in names))
    both = beside.join(first, "at1").join(blocks.select("at", *names), "at")
    out = blocks.mapInArrow(compare, kind).union(both.mapInArrow(compare, kind))
    return out if pairs else out.groupBy("s").agg(F.sum("m").alias("m"))


def _resolved(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sets (``document_sets``), ``s, c`` of every linked set and its component, and the sets ``s, h`` of at least those."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(document_sets(docs, doc_id, text))
    same = Window.partitionBy("g")
    live = scratch.keep(
        signature_rows(docs, text)
        .withColumns({"lead": F.min("s").over(same), "last": F.max("s").over(same)})
        .where(F.col("lead") != F.col("last"))
        .select("g", "s", "lead")
        .distinct()
    )
    release(docs.sparkSession)  # the signatures
    counts = rows.join(live.select("s").distinct(), "s", "left_semi").select("s", "n", "k").dropDuplicates(["s"])
    counts = cut_lineage(counts)
    star = live.where(F.col("s") != F.col("lead")).groupBy(F.col("s").alias("a"), F.col("lead").alias("b")).agg(F.count("*").alias("w"))
    # First, of the partners that may be similar, the one with which a set shares most signatures.
    best = _near(star, counts).groupBy("a").agg(F.max_by("b", F.struct("w", "b")).alias("b"))
    tested = cut_lineage(best)
    links, sets = _linked(tested, docs, text, rows)
    found = components(links)
    release(docs.sparkSession)
    # Then the buckets whose sets still lie in different components.
    apart = _open(live, found)
    scratch.drop(live)
    if not apart.isEmpty():
        pairs = cut_lineage(_across(apart, counts).join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            more, others = _linked(pairs, docs, text, rows)
            if not more.isEmpty():
                found = components(links.union(more))
                sets = sets.union(others.join(sets.select("s"), "s", "left_anti"))
    return rows, found, sets


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``d, n, first, links``: each document's number of shingles, the smallest id of its component
    and the number of other documents (rows) that are similar to it, those with an equal set included."""
    rows, found, sets = _resolved(docs, doc_id, text)
    joined = rows.groupBy("s").agg(F.min("d").alias("first"), F.count("*").alias("w")).join(found, "s", "left")
    named = cut_lineage(joined.withColumn("c", F.coalesce("c", "s")))
    lowest = named.groupBy("c").agg(F.min("first").alias("first"))
    release(docs.sparkSession)  # what the candidates needed
    others = _all_links(found, sets, named.select("s", "w"))
    of_set = named.select("s", "c", "w").join(lowest, "c").join(others, "s", "left")
    of_set = of_set.select("s", "first", (F.col("w") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
    filled = rows.where(F.col("n") > 0).join(of_set, "s").select("d", "n", "first", "links")
    return filled.union(rows.where(F.col("n") == 0).select("d", "n", F.col("d").alias("first"), F.lit(0).cast("long")))


def exact_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join itself: ``a, b`` (a < b), all pairs of different sets that are similar, and ``d, s``, the set of every document.

    Documents with an equal set, other than the empty one (null here), are similar too.
    """
    rows, found, sets = _resolved(docs, doc_id, text)
    pairs = _all_links(found, sets, rows.groupBy("s").agg(F.count("*").alias("w")), pairs=True)
    return pairs, rows.select("d", F.when(F.col("n") > 0, F.col("s")).alias("s"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, with the smallest id.

    What decides is the row, not its id: one id with texts of two components stays once
    for each, a component without any id keeps one row, and every row without words stays.
    """
    rows, found, _ = _resolved(docs, doc_id, text)
    # Rows with an id come before those without.
    low = F.min(F.struct(F.col("d").isNull().alias("none"), "d", "t")).alias("low")
    of_set = rows.where(F.col("n") > 0).groupBy("s").agg(low).join(found, "s", "left")
    stays = of_set.groupBy(F.coalesce("c", "s").alias("c")).agg(F.min("low").alias("low"))
    stays = stays.select(F.col("low.d").alias("__llm_d"), F.col("low.t").alias("__llm_t"))
    filled = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    keyed = docs.where(filled).select("*", *_row_key(doc_id, text, "__llm_a", "__llm_b"))
    same = F.col("__llm_a").eqNullSafe(F.col("__llm_d")) & (F.col("__llm_b") == F.col("__llm_t"))
    kept = keyed.join(stays, same).dropDuplicates(["__llm_a", "__llm_b"]).select(*docs.columns)
    return kept.union(docs.where(~filled))


def digest(docs: DataFrame) -> DataFrame:
    return link_components(docs.select("doc_id", "text")).select(
        F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first").alias("component_id"), F.col("links").alias("n_links")
    )
