"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A text is the bag of the character n-grams of its distinct words, borders included
(a line repeated a hundred times says no more than once; a text beyond a megabyte is read in
pieces that remember the words of those before). Each n-gram
has a hashed vector; their average goes through a linear softmax, and vectors and
softmax are trained together (numpy, plain steps for the vectors, Adam for the softmax). A misspelling shares most n-grams with the
word it comes from, so it scores alike without having been seen. Since averaging and
the linear layer commute, scoring needs one number per n-gram: whole texts are scored
in one pass over their bytes, in pieces of bounded size, without a shuffle.

Training reads a bounded, documented sample: ``PER_LABEL`` rows of each label, drawn by
hash. The sampled texts become n-gram counts on the executors, at most one entry a
bucket, so long texts cannot overwhelm the driver.

Defined cases: null and empty texts and texts without a word score as the bias alone;
rows without a label or with null labels are never learned from; several labels of one
document count as 1 if any is 1; rows that are repeated or share an id are scored each for
itself; without labels of both kinds every score is the share
of the one kind (0 without any label); further columns of the input stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, flat, fold, row_groups, words_in

PER_LABEL = 3000
AT_MOST = 6000
GRAMS = (3, 4, 5)
BITS = 17
NEUTRAL = 300  # n-grams without a vector that every bag holds besides its own: short texts need clear words
DIM = 8
EPOCHS = 20
RATE = 5.0
MIN_TEXTS = 5
BATCH = 64
SEED = 3
CUT = 0.3
PIECE = 1 << 20  # bytes scored at a time

# Words are runs of letters, digits and bytes of other scripts; A-Z is lowered.
_FOLD = np.full(256, 32, np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _FOLD[_c] = _c
_FOLD[65:91] = np.arange(97, 123)


def gram_codes(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the positions of n-grams inside one word (a border may be first or last), and their buckets. ``data`` is folded."""
    b = data
    rim = b == 32
    inner = np.concatenate([[0], np.cumsum(rim)])
    code = b.astype(np.uint32)
    wide = code
    for n in range(2, GRAMS[-1] + 1):
        if len(b) < n:
            return
        wide = wide[: len(b) - n + 1] * np.uint32(1_000_003) + code[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(inner[n - 1 : len(b)] == inner[1 : len(b) - n + 2])
            mixed = (wide[at] ^ (wide[at] >> np.uint32(15))) * np.uint32(2654435761)
            yield at, (mixed >> np.uint32(32 - BITS)).astype(np.int64)


def distinct_words(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's words once, in order, with a border before and after each word; the new offsets; their hashes.

    Words whose hash is among the sorted ``known`` ones are left out.
    """
    n = len(offsets) - 1
    text = np.full(len(data) + n + 1, 32, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _FOLD[data]
    edges = offsets + np.arange(n + 1)
    start, end, word = words_in(text, text == 32)
    row = np.searchsorted(edges, start, side="right") - 1
    key = word + row.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    found, first = np.unique(key, return_index=True)
    if known is not None and len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        found, first = found[known[at] != found], first[known[at] != found]
    first = np.sort(first)
    start, end, row = start[first], end[first], row[first]
    size = end - start + 1  # the word and the border before it
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(to[-1]) + 1, 32, np.uint8)
    out[:-1] = text[np.repeat(start - 1 - to[:-1], size) + np.arange(to[-1])]
    return out, to[np.searchsorted(row, np.arange(n + 1))], found


def distinct_pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct words of one row of any length, in pieces. What is held are the hashes of its words."""
    known = np.zeros(0, np.uint64)
    for piece in long_pieces(data):
        text, _, found = distinct_words(piece, np.array([0, len(piece)]), known)
        known = np.union1d(known, found)
        yield text


def sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the sum of its words' n-grams' numbers, and the count of n-grams."""
    text, starts, _ = distinct_words(data, offsets)
    return _sums(text, starts, table)


def _sums(text: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(starts) - 1
    total, count = np.zeros(n), np.zeros(n)
    for at, code in gram_codes(text):
        edge = np.searchsorted(at, starts)
        run = np.concatenate([[0.0], np.cumsum(table[code], dtype=np.float64)])
        total += run[edge[1:]] - run[edge[:-1]]
        count += np.diff(edge)
    return total, count


def long_pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long row in pieces of about PIECE bytes, cut between words only."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):
            rim = np.flatnonzero(_FOLD[data[end : end + PIECE]] == 32)
            if len(rim):
                end += int(rim[0])
                break
            end = min(end + PIECE, len(data))
        yield data[at:end]
        at = end


def bag_means(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each row's average number over its n-grams; 0 without any."""
    out = np.zeros(len(offsets) - 1)
    for a, b in row_groups(offsets, PIECE):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if b - a == 1 and len(part) > PIECE:
            both = [_sums(p, np.array([0, len(p)]), table) for p in distinct_pieces(part)]
            total, count = sum(t for t, _ in both), sum(c for _, c in both)
        else:
            total, count = sums(part, own, table)
        out[a:b] = total / (count + NEUTRAL)
    return out


def bag(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one row and their shares."""
    counts = np.zeros(1 << BITS, np.int64)
    for text in distinct_pieces(data):
        for _, code in gram_codes(text):
            counts += np.bincount(code, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / (counts.sum() + NEUTRAL)).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """The number of each bucket, and the bias; ``prior`` is the share of label 1 among all labels."""
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, DIM).astype(np.float32)  # difference of the two classes' rows
    scale = 100.0  # averages over a text are small numbers
    odds = np.log(prior / (1 - prior))
    # The sample is drawn by label: the loss weighs its rows back to their true shares.
    own = label.mean()
    weight = np.where(label == 1, prior / own, (1 - prior) / (1 - own))
    bias = odds
    m2, v2, m3, v3 = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    # Buckets of few sampled texts would only be learned by heart: they stay at zero.
    seen = np.zeros(1 << BITS, np.int64)
    for cells, _ in bags:
        seen[cells] += 1
    table[seen < MIN_TEXTS] = 0
    bags = [(c[k], s[k]) for c, s in bags for k in [seen[c] >= MIN_TEXTS]]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        lr = 1 - epoch / EPOCHS
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            cells = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] for r in rows])
            sizes = np.array([len(bags[r][0]) for r in rows])
            edges = np.concatenate([[0], np.cumsum(sizes)])
            flow = table[cells] * (share * scale)[:, None]
            run = np.concatenate([np.zeros((1, DIM)), np.cumsum(flow, axis=0, dtype=np.float64)])
            hidden = run[edges[1:]] - run[edges[:-1]]
            p = 1 / (1 + np.exp(-np.clip(hidden @ soft + bias, -30, 30)))
            g = (p - label[rows]) * weight[rows] / len(rows)
            each = np.repeat(g, sizes) * share * scale
            pull = np.bincount(cells, each, 1 << BITS)
            used = np.flatnonzero(pull)
            pull = (pull[used, None] * soft[None, :]).astype(np.float32)
            step += 1
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            gs, gb = g @ hidden, g.sum()
            m2, v2 = 0.9 * m2 + 0.1 * gs, 0.999 * v2 + 0.001 * gs**2
            m3, v3 = 0.9 * m3 + 0.1 * gb, 0.999 * v3 + 0.001 * gb**2
            # Plain steps for the vectors: a rare n-gram then moves little.
            table[used] -= np.float32(lr * RATE) * pull
            soft -= (0.01 * lr * m2 / c1 / (np.sqrt(v2 / c2) + 1e-6)).astype(np.float32)
            bias -= 0.01 * lr * m3 / c1 / (np.sqrt(v3 / c2) + 1e-6)
    return (table @ soft * scale).astype(np.float32), float(bias)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Numbers of the buckets and bias, learned from rows of ``labels`` (doc_id, toxic) with a text in ``docs``."""
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", 4) != 2))
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") != 0).cast("int")).alias("y"))
    )
    shares = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        p = 1 - 1e-9 if 1 in shares else 1e-9
        return np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p)))
    chosen = bounded_sample(marks, "y", "doc_id", PER_LABEL, AT_MOST)
    # At most AT_MOST ids: small enough to be sent to every task.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def bags(batches):
        for b in batches:
            data, offsets = flat(b.column(2))
            found = [bag(data[offsets[i] : offsets[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.string()),
                    b.column(1),
                    pa.array([x.tobytes() for x, _ in found], pa.binary()),
                    pa.array([x.tobytes() for _, x in found], pa.binary()),
                ],
                ["k", "y", "cells", "share"],
            )

    prior = shares[1] / sum(shares.values())

    def learn(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        sample = pa.Table.from_batches(got).sort_by("k")
        y = sample.column("y").to_numpy().astype(np.float64)
        if len(np.unique(y)) < 2:
            p = 1 - 1e-9 if y[0] else 1e-9
            table, bias = np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p)))
        else:
            cells, share = (sample.column(c).to_pylist() for c in ("cells", "share"))
            kept = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(cells, share)]
            table, bias = train(kept, y, prior)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([bias])], ["table", "bias"])

    # The sample is bounded: one task learns from it, and only the model goes to the driver.
    sample = rows.mapInArrow(bags, "k string, y int, cells binary, share binary").repartition(1)
    model = sample.mapInArrow(learn, "table binary, bias double").collect()
    if not model:  # no text of the sample is there
        return np.zeros(1 << BITS, np.float32), float(np.log(1e-9 / (1 - 1e-9)))
    return np.frombuffer(bytes(model[0]["table"]), np.float32), model[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with ``out`` between 0 and 1."""
    spark = SparkSession.active()
    shared = spark.sparkContext.broadcast(model)  # 2**BITS numbers, whatever the corpus

    @F.pandas_udf("double")
    def rate(texts):
        table, bias = shared.value
        data, offsets = flat(pa.array(texts, pa.large_string(), from_pandas=True))
        import pandas as pd

        return pd.Series(1 / (1 + np.exp(-np.clip(bag_means(data, offsets, table) + bias, -60, 60))))

    return docs.withColumn(out, rate(F.col(text)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
