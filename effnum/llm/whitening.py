"""Whitening of embeddings: principal components scaled to unit variance.

Entries become integers, ``floor(64 * c) + 1000000``, so counts and sums are exact. The
fit list holds every distinct integer vector once. Three passes over it, each combined
from one small matrix a task: count and sums; the covariance of the centred vectors (an
entry is centred as the integer ``n * x - S``, hence exactly, before anything is
multiplied); the covariance of the whitened vectors, which says how far from the
identity it is. The covariance of a vector length is decomposed in one task: Householder
reflections make it tridiagonal, Sturm counts bisect its leading eigenvalues, inverse
iteration finds their vectors, those of close eigenvalues orthogonalised against each
other, and the reflections are applied backwards. Components and sums are broadcast (a
bound on their bytes is checked; lengths beyond it go in further rounds) and project
every row where it is read.

Defined cases: a vector that is null or holds null or non-finite entries has no rows,
and neither has an empty one; rows that repeat, share an id or have none are projected
each for itself; vectors are whitened with those of their own length; an entry beyond
64-bit integers becomes the nearest one, and products beyond 64 bits are formed in
Python integers; a deviation that a long cannot hold is null; components whose
eigenvalue is below ``LEAST`` of the trace (as for constant or dependent dimensions, or
fewer distinct vectors than components) cannot be scaled in double precision and are left
out, hence a fit list of one vector gives no rows; an empty table gives none either;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LEAST = 1e-11  # of the trace
CLOSE = 1e-3  # of the largest eigenvalue: distance in which vectors are orthogonalised again
HELD = 1 << 27  # bytes of matrices that a task holds
SENT = 1 << 26  # bytes of components that are broadcast at a time
FAR = 1 << 62


# --- eigenvectors of a symmetric matrix ---


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and reflectors (columns) of a symmetric matrix made tridiagonal by Householder."""
    a = np.array(a, np.float64)
    d = len(a)
    reflectors = np.zeros((d, max(0, d - 2)))
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.abs(v).max()
        if not np.abs(v[1:]).max() > 0:
            continue  # already tridiagonal here
        v /= size
        length = np.sqrt(v @ v)
        v[0] += np.copysign(length, v[0])
        v /= np.sqrt(v @ v)
        reflectors[k + 1 :, k] = v
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        column = a[k + 1 :, k]
        column -= 2.0 * (v @ column) * v
        a[k, k + 1 :] = column
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``at``."""
    tiny = np.finfo(np.float64).tiny / np.finfo(np.float64).eps
    square = np.concatenate([[0.0], off * off])
    q = np.ones_like(at)
    below = np.zeros(len(at), np.int64)
    for x, s in zip(diagonal, square):
        q = x - at - s / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to neighbouring numbers."""
    d = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    slack = np.finfo(np.float64).eps * max(abs(low[0]), abs(high[0]), np.finfo(np.float64).tiny)
    low, high = low - 2 * slack, high + 2 * slack
    rank = d - np.arange(k)  # at least so many eigenvalues lie below what is above the k-th
    for _ in range(200):
        middle = low + (high - low) / 2
        if not ((low < middle) & (middle < high)).any():
            break
        above = sturm(diagonal, off, middle) >= rank
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return low + (high - low) / 2


def _shifted(diagonal: np.ndarray, off: np.ndarray, shift: float):
    """A solver of (T - shift) y = b: elimination with row exchanges, pivots kept away from zero."""
    d = len(diagonal)
    least = np.finfo(np.float64).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny)
    u0, u1, u2 = diagonal - shift, np.append(off, 0.0), np.zeros(d)
    swap, factor = np.zeros(d, bool), np.zeros(d)
    for i in range(d - 1):
        below = (off[i], u0[i + 1], u1[i + 1])
        if abs(below[0]) > abs(u0[i]):
            own = (u0[i], u1[i], u2[i])
            u0[i], u1[i], u2[i] = below
            below, swap[i] = own, True
        elif abs(u0[i]) < least:
            u0[i] = least
        factor[i] = below[0] / u0[i]
        u0[i + 1], u1[i + 1] = below[1] - factor[i] * u1[i], below[2] - factor[i] * u2[i]
    if abs(u0[-1]) < least:
        u0[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i in range(d - 1):
            if swap[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor[i] * y[i]
        for i in range(d - 1, -1, -1):
            if i + 1 < d:
                y[i] -= u1[i] * y[i + 1]
            if i + 2 < d:
                y[i] -= u2[i] * y[i + 2]
            y[i] /= u0[i]
            big = abs(y[i])
            if big > 1e200:
                y /= big
        return y

    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) to falling eigenvalues of a tridiagonal matrix."""
    d = len(diagonal)
    reach = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    rng = np.random.default_rng(11)
    out = np.zeros((d, len(values)))
    first, last = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * reach:
            first = j  # a new cluster
        # Equal eigenvalues would give equal solutions: they are moved apart by roundings.
        shift = min(value, last - 10 * np.finfo(np.float64).eps * reach) if j > first else value
        last = shift
        solve, y = _shifted(diagonal, off, shift), rng.uniform(-1, 1, d)
        for _ in range(5):
            y = solve(y / np.abs(y).max())
            y /= np.sqrt(y @ y)
            for _ in range(2):
                y -= out[:, first:j] @ (out[:, first:j].T @ y)
                y /= np.sqrt(y @ y)
        out[:, j] = y
    return out


def components(covariance: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and unit eigenvectors (columns); those too small to be told from 0 are left out."""
    d, trace = len(covariance), float(np.trace(covariance))
    if not trace > 0:
        return np.zeros(0), np.zeros((d, 0))
    diagonal, off, reflectors = tridiagonal(covariance / trace)
    values = leading(diagonal, off, min(k, d))
    values = values[values >= LEAST]
    vectors = inverse_iteration(diagonal, off, values)
    for j in range(reflectors.shape[1] - 1, -1, -1):
        v = reflectors[:, j : j + 1]
        vectors -= 2.0 * v @ (v.T @ vectors)
    # One product with the whole matrix gives the eigenvalues beyond the roundings of the reduction.
    vectors /= np.sqrt((vectors * vectors).sum(0))
    return (vectors * (covariance @ vectors)).sum(0), vectors


# --- passes over the vectors ---


def integer_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, x``: the rows whose vector has entries, all finite, as integers."""
    v = F.col(vector).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = table.select(F.col(key).alias("id"), v.alias("v")).where((F.size("v") > 0) & F.forall("v", finite))
    # Beyond a long, floor() keeps to the nearest one; the shift must not leave it either.
    whole = lambda c: F.least(F.floor(c * SCALE), F.lit((1 << 63) - 1 - SHIFT)) + SHIFT
    return rows.select("id", F.transform("v", whole).alias("x"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of a batch by their length: length, places of the rows, matrix."""
    x = batch.column("x")
    size = x.value_lengths().to_numpy(zero_copy_only=False)
    values, ends = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield int(d), at, values[(ends[at] - d)[:, None] + np.arange(d)]


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """``n * x - S``, exactly."""
    if n * (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) + int(max(abs(int(s)) for s in total)) < FAR:
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


@dataclass
class Model:
    n: int
    total: np.ndarray  # the sums, as Python integers
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # columns
    error: float = float("nan")

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centred integers and whitened rows."""
        z = _centred(x, self.n, self.total)
        return z, (z.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)


def _sums(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Count and sums of each length."""

    def run(batches):
        for b in batches:
            for d, _, x in _by_length(b):
                # High and low halves, so that no sum of a batch leaves 64 bits.
                parts = [(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), np.full(d, len(x), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), *map(pa.array, parts)], ["d", "i", "high", "low", "n"])

    part = fit.select("x").mapInArrow(run, "d long, i long, high long, low long, n long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    lines = part.groupBy("d", "i").agg(exact("high"), exact("low"), F.sum("n").alias("n"))
    whole = lines.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "high", "low"))).alias("s"))
    # One entry a dimension of each length.
    return {r["d"]: (r["n"], np.array([(int(s["high"]) << 32) + int(s["low"]) for s in r["s"]], object)) for r in whole.toLocalIterator()}


def _matrices(fit: DataFrame, lines_of) -> DataFrame:
    """``d, i, line``: the sum over ``fit`` of the matrices that ``lines_of(length, x)`` gives, line by line."""

    def run(batches):
        held: dict[int, np.ndarray] = {}

        def flush():
            for d, m in held.items():
                line = pa.array(list(m), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), d)), pa.array(np.arange(len(m))), line], ["d", "i", "line"])
            held.clear()

        for b in batches:
            for d, _, x in _by_length(b):
                m = lines_of(d, x)
                if m is None:
                    continue
                if d in held:
                    held[d] += m
                else:
                    held[d] = m
                if sum(v.nbytes for v in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    part = fit.select("x").mapInArrow(run, "d long, i long, line array<double>")
    each = part.select("d", "i", F.posexplode("line").alias("j", "y")).groupBy("d", "i", "j").agg(F.sum("y").alias("y"))
    lines = each.groupBy("d", "i").agg(F.sort_array(F.collect_list(F.struct("j", "y"))).alias("line"))
    return lines.select("d", "i", F.transform("line", lambda x: x["y"]).alias("line"))


def _solved(lines: DataFrame, counts: dict[int, int], k: int) -> list[pd.Series]:
    """Trace, eigenvalues and eigenvectors of each length's matrix, solved in a task each."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        d = int(group["d"].iloc[0])
        m = np.array(group.sort_values("i")["line"].tolist()) / float(counts[d])
        m = (m + m.T) / 2
        values, vectors = components(m, k)
        return pd.DataFrame({"d": [d], "trace": [float(np.trace(m))], "e": [values.tolist()], "v": [vectors.T.ravel().tolist()]})

    return lines.groupBy("d").applyInPandas(solve, "d long, trace double, e array<double>, v array<double>").toLocalIterator()


def fit(rows: DataFrame, k: int = COMPONENTS) -> list[dict[int, Model]]:
    """The models of all vector lengths in rounds of at most SENT bytes (``rows``: x, integer vectors)."""
    spark = SparkSession.active()
    distinct = cut_lineage(rows.select("x").distinct())
    sums = _sums(distinct)
    rounds: list[list[int]] = [[]]
    for d in sorted(sums):
        if rounds[-1] and sum(8 * e * (k + 2) for e in rounds[-1]) + 8 * d * (k + 2) > SENT:
            rounds.append([])
        rounds[-1].append(d)
    out = []
    for lengths in rounds:
        shared = spark.sparkContext.broadcast({d: sums[d] for d in lengths})

        def scatter(d, x, shared=shared):
            if d not in shared.value:
                return None
            n, total = shared.value[d]
            z = _centred(x, n, total).astype(np.float64) / n
            return z.T @ z

        models = {}
        for r in _solved(_matrices(distinct, scatter), {d: sums[d][0] for d in lengths}, k):
            n, total = sums[r["d"]]
            models[r["d"]] = Model(n, total, r["trace"], np.array(r["e"]), np.array(r["v"]).reshape(len(r["e"]), r["d"]).T)
        sent = spark.sparkContext.broadcast(models)

        def white(d, x, sent=sent):
            if d not in sent.value or not len(sent.value[d].values):
                return None
            w = sent.value[d].project(x)[1]
            # The last line is the sum, so the mean is taken off as well.
            return np.vstack([np.hstack([w.T @ w, np.zeros((w.shape[1], 1))]), np.append(w.sum(0), len(w))])

        seen: dict[int, list] = {}
        for r in _matrices(distinct, white).toLocalIterator():  # k + 1 lines a length
            seen.setdefault(r["d"], []).append((r["i"], r["line"]))
        for d, lines in seen.items():
            m = np.array([line for _, line in sorted(lines)]) / models[d].n
            mean = m[-1, :-1]
            models[d].error = float(np.abs(m[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())
        out.append(models)
    return out


def whiten(rows: DataFrame, models: list[dict[int, Model]]) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of every row (id, x) and component."""
    spark = SparkSession.active()
    kind = dict(rows.dtypes)["id"]
    shape = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    parts = []
    for part in models or [{}]:
        shared = spark.sparkContext.broadcast(part)  # SENT bytes at most

        def run(batches, shared=shared):
            for b in batches:
                for d, at, x in _by_length(b):
                    m = shared.value.get(d)
                    k = 0 if m is None else len(m.values)
                    if not k:
                        continue
                    z, w = m.project(x)
                    if z.dtype != object and d * float(np.abs(z).max(initial=0)) ** 2 < FAR:
                        deviation = pa.array(np.repeat((z * z).sum(1), k))
                    else:
                        exact = [sum(int(v) ** 2 for v in row) for row in z]
                        deviation = pa.array([v if v < 1 << 63 else None for v in exact for _ in range(k)], pa.int64())
                    many = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column("id").take(pa.array(np.repeat(at, k))),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                            pa.array(np.full(many * k, m.n)),
                            deviation,
                            pa.array(w.ravel()),
                            pa.array(np.tile(m.values / m.trace, many)),
                            pa.array(np.full(many * k, m.error)),
                        ],
                        ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

        parts.append(rows.select("id", "x").mapInArrow(run, shape))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def digest(table: DataFrame) -> DataFrame:
    rows = integer_vectors(table)
    return whiten(rows, fit(rows)).withColumnRenamed("id", "vec_id")
