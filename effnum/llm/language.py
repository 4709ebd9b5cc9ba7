"""Language identification with a byte convolutional network trained in numpy.

Bytes have learned vectors; filters of several widths run over windows of fixed length,
each filter's largest response in the window goes through a rectifier, and a softmax
over the languages follows. A text is cut into windows that cover all of it, and the
windows' probabilities are averaged by length. For scoring, each filter's weights are
multiplied into the byte vectors beforehand, so a response is a sum of table rows, and
windows of many documents run as one batch. No shuffle.

Training reads a bounded, documented sample: ``PER_LANG`` texts of each language, at
most ``AT_MOST`` in all, drawn by hash, ``SPREAD`` windows of each.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows with
null language are predicted but never learned from; with one language in the sample all
are predicted as it, with none all are ``und`` with score 0; further columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, flat, fold

PER_LANG = 500
AT_MOST = 20_000
SPREAD = 4
WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8  # of each width
DIM = 8
EPOCHS = 6
BATCH = 64
SEED = 5
WIDEST = max(WIDTHS)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows covering every row, each filled up with zeros; their rows and their lengths."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    start = (np.arange(len(row)) - first) * WINDOW
    length = np.minimum(WINDOW, sizes[row] - start)
    at = (offsets[row] + start)[:, None] + np.arange(WINDOW)[None, :]
    inside = np.arange(WINDOW)[None, :] < length[:, None]
    out = np.where(inside, data[np.minimum(at, max(0, len(data) - 1))], 0).astype(np.uint8) if len(row) else np.zeros((0, WINDOW), np.uint8)
    return out, row, length


class ByteNet:
    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.languages = languages
        self.vectors = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.filters = rng.normal(0, 0.2, (WIDEST * DIM, n)).astype(np.float32)
        self.reach = np.repeat(
            (np.arange(WIDEST)[:, None] < np.repeat(WIDTHS, FILTERS)[None, :]), DIM, axis=0
        ).astype(np.float32)
        self.filters *= self.reach
        self.offset = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def train(self, windows: np.ndarray, label: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        names = ("vectors", "filters", "offset", "out", "bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        step, last = 0, EPOCHS * -(-len(windows) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                rows = order[i : i + BATCH]
                x = windows[rows].copy()
                # Short texts are windows filled up with zeros: a part of the batch is cut short.
                cut = np.where(rng.random(len(rows)) < 0.3, rng.integers(16, WINDOW, len(rows)), WINDOW)
                x[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
                step += 1
                lr = 0.005 * (1 - step / (last + 1))
                for k, g in self.gradients(x, label[rows]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g**2
                    w = getattr(self, k)
                    w -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-6)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        n, spots = len(x), WINDOW - WIDEST + 1
        e = self.vectors[x].reshape(n, WINDOW * DIM)
        view = np.lib.stride_tricks.sliding_window_view(e, WIDEST * DIM, axis=1)[:, :: DIM]
        response = (view.reshape(n * spots, -1) @ self.filters).reshape(n, spots, -1)
        best = response.argmax(1)
        pooled = np.take_along_axis(response, best[:, None, :], 1)[:, 0] + self.offset
        hidden = np.maximum(pooled, 0)
        z = hidden @ self.out + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), label] -= 1
        p /= n
        back = (p @ self.out.T) * (pooled > 0)
        # Only the place of a filter's largest response takes part.
        seen = view[np.arange(n)[:, None], best]  # rows, filters, inputs
        filters = np.einsum("nf,nfk->kf", back, seen) * self.reach
        flow = back[:, :, None] * self.filters.T[None]
        bytes_ = x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(WIDEST)].reshape(-1)
        vectors = np.zeros_like(self.vectors)
        np.add.at(vectors, bytes_, flow.reshape(-1, DIM))
        return {"vectors": vectors, "filters": filters, "offset": back.sum(0), "out": hidden.T @ p, "bias": p.sum(0)}

    def tables(self) -> list[np.ndarray]:
        """For each place within a filter: the response of every byte there."""
        return [np.ascontiguousarray(self.vectors @ self.filters[j * DIM : (j + 1) * DIM]) for j in range(WIDEST)]

    def probabilities(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        spots = WINDOW - WIDEST + 1
        for i in range(0, len(windows), BATCH):
            x = windows[i : i + BATCH]
            response = tables[0][x[:, :spots]]
            for j in range(1, WIDEST):
                response += tables[j][x[:, j : j + spots]]
            z = np.maximum(response.max(1) + self.offset, 0) @ self.out + self.bias
            p = np.exp(z - z.max(1, keepdims=True))
            out[i : i + BATCH] = p / p.sum(1, keepdims=True)
        return out

    def rows(self, data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Each row's language (its number) and score, from all its windows; memory for ``1 << 22`` bytes at a time."""
        n = len(offsets) - 1
        total = np.zeros((n, len(self.languages)))
        for a, b, lo, hi in spans(offsets, 1 << 22):
            own = np.clip(offsets[a : b + 1], lo, hi) - lo
            w, row, length = windows_of(data[lo:hi], own)
            if len(w):
                np.add.at(total, a + row, self.probabilities(w, tables) * length[:, None])
        share = total / np.maximum(total.sum(1, keepdims=True), 1e-9)
        return share.argmax(1), share.max(1)


def spans(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, int, int]]:
    """Rows first to last and the bytes low to high of them, ``limit`` (a multiple of a window) at a time; a longer row in turns."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        if last > first:
            yield first, last, int(offsets[first]), int(offsets[last])
            first = last
            continue
        for low in range(int(offsets[first]), int(offsets[first + 1]), limit):
            yield first, first + 1, low, min(low + limit, int(offsets[first + 1]))
        first += 1


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ByteNet:
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(key, 3) != 1))
    chosen = bounded_sample(known.select(F.col(key).alias("k"), F.col(lang).alias("y")), "y", "k", PER_LANG, AT_MOST)
    # At most AT_MOST ids: small enough to be sent to every task.
    ids = chosen.select("k", "y").distinct()
    rows = known.select(F.col(key).alias("k"), F.col(lang).alias("y"), F.col(text).alias("text")).join(F.broadcast(ids), ["k", "y"])

    def cut(batches):
        for b in batches:
            data, offsets = flat(b.column(2))
            keep, at = [], []
            for i in range(b.num_rows):
                w = windows_of(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0]
                pick = np.unique(np.linspace(0, len(w) - 1, SPREAD).astype(int)) if len(w) else []
                keep += [w[j].tobytes() for j in pick]
                at += [i] * len(pick)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.string()).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), pa.array(keep, pa.binary())],
                ["k", "y", "w"],
            )

    got = rows.mapInArrow(cut, "k string, y string, w binary").toArrow().sort_by([("y", "ascending"), ("k", "ascending"), ("w", "ascending")]).to_pydict()
    languages = sorted(set(got["y"]))
    net = ByteNet(languages)
    if len(languages) > 1:
        x = np.frombuffer(b"".join(got["w"]), np.uint8).reshape(-1, WINDOW)
        net.train(x, np.array([languages.index(y) for y in got["y"]]))
    return net


def predict(docs: DataFrame, net: ByteNet, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred`` and ``score``."""
    spark = SparkSession.active()
    shared = spark.sparkContext.broadcast((net, net.tables()))  # a fixed size for each language

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts):
        import pandas as pd

        net, tables = shared.value
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        lettered = np.array(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False))
        if not net.languages:
            return pd.DataFrame({"lang_pred": ["und"] * len(column), "score": [0.0] * len(column)})
        best, score = net.rows(*flat(column), tables)
        names = np.array([*net.languages, "und"], object)
        return pd.DataFrame(
            {"lang_pred": names[np.where(lettered, best, len(net.languages))], "score": np.where(lettered, score, 0.0)}
        )

    found = docs.withColumn("__llm_g", guess(F.col(text)))
    return found.withColumns({"lang_pred": F.col("__llm_g.lang_pred"), "score": F.col("__llm_g.score")}).drop("__llm_g")


def digest(docs: DataFrame) -> DataFrame:
    found = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
