"""Exact top-k search by inner product over a pivot-distance index.

Vectors are lifted by one coordinate, so that the largest inner product is the smallest
Euclidean distance. Each one is keyed by its nearest pivot and the distance to it, sorted
by that key and cut into annuli of bounded size. A query first reads the annulus of its
own pivot nearest to its own distance, which gives a first k-th best score; by the
triangle inequality an annulus can only hold better rows if its distances are near
enough to the query's distance from that pivot, so the search goes outwards from there
and all other annuli are never read. Queries are cut into chunks in the same order, so
most annuli are already ruled out for a whole chunk by the small directory.

The pivots come from a bounded sample (``SAMPLE`` rows); every row is indexed, and the
result does not depend on the sample. A pivot with most of the rows is many annuli.

Defined cases: vectors null, empty or with null or non-finite components take no part;
repeated rows are candidates each for itself, and ask once; rows without an id are
candidates (after all others among equals, null in the result) and never ask; of one id
with several vectors the query's ranks are those of all its vectors together; vectors are
compared with those of the same length, each length by a search of its own; vectors too
long for exact sums in doubles (``LARGE``) are a search of their own too, without an index
and in integers, and a score beyond 64 bits is the nearest long; with fewer candidates
than k all are returned; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .vectors import asked, best, clean, lengths, matrix, named, names, packed, sample

SAMPLE = 4096
PIVOTS = 32
ANNULUS = 1024  # rows of an annulus
CHUNK = 128  # queries of a chunk
SCALE = 256
LARGE = 2.0**50  # squared norm from which a vector is compared in integers
NOTHING = -(1 << 63) + 1  # the score of no candidate


def lifted(x: np.ndarray, m2: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(m2 - (x * x).sum(1), 0))[:, None]])


def choose_pivots(x: np.ndarray, seed: int = 1) -> np.ndarray:
    """A few rounds of means around random rows."""
    rng = np.random.default_rng(seed)
    pivots = x[rng.choice(len(x), min(PIVOTS, len(x)), replace=False)]
    for _ in range(4):
        near = distances(x, pivots).argmin(1)
        pivots = np.stack([x[near == p].mean(0) if (near == p).any() else pivots[p] for p in range(len(pivots))])
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):  # of queries without a bound
        d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.nan_to_num(np.maximum(d2, 0), nan=0.0, posinf=1e300))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of vectors of whole numbers, exact, as longs (beyond them the nearest one)."""
    top = lambda x: float(np.abs(x).max(initial=0.0))
    most = top(q) * top(v) * q.shape[1]
    if most < 2.0**52:
        return (q @ v.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q) @ whole(v).T if len(q) and len(v) else np.zeros((len(q), len(v)), object)
    return np.clip(exact, NOTHING + 1, (1 << 63) - 1).astype(np.int64)


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest inner products per query.

    Both inputs have columns ``id, v`` with integral values of v (``clean`` and
    ``whole_numbers``); a row with a query's own id is not its candidate.
    """
    spark = rows.sparkSession
    hits = spark.createDataFrame([], "query_id long, vec_id long, score long")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    for large in (False, True):
        tier = rows.where((norm >= LARGE) if large else (norm < LARGE))
        for dim, total, m2 in lengths(tier):
            hits = hits.union(_of_length(tier.where(F.size("v") == dim), queries, k, dim, total, m2, large))
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(ranked).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _of_length(rows: DataFrame, queries: DataFrame, k: int, dim: int, total: int, m2: float, large: bool) -> DataFrame:
    """``query_id, vec_id, score``, the k best and others, for ``rows`` of one length; ``large`` rows have one pivot and no bounds."""
    if large:
        m2, pivots = 0.0, np.zeros((1, dim + 1))
    else:
        pivots = choose_pivots(lifted(sample(rows, SAMPLE, total)[1], m2))

    def keyed(batches, query=False):
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            x = np.hstack([v, np.zeros((len(v), 1))]) if query or large else lifted(v, m2)
            d = distances(x, pivots) * (not large)
            p = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("v"), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])],
                ["id", "v", "p", "d"],
            )

    shape = "id long, v array<double>, p int, d double"

    def sorted_runs(df, query):
        out = df.mapInArrow(lambda bs: keyed(bs, query), shape)
        return out.repartitionByRange("p", "d", "id").sortWithinPartitions("p", "d", "id", "v")

    def annuli(batches):
        for a, ((p,), t) in zip(names(), packed(batches, ("p",), ANNULUS)):
            ids, v = matrix(t)
            d = t.column("d").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array([a]), pa.array([p], pa.int32()), pa.array([d[0]]), pa.array([d[-1]]), pa.array([len(ids)]),
                 pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([d.tobytes()], pa.binary())],
                ["a", "p", "lo", "hi", "n", "ids", "vecs", "ds"],
            )

    def chunks(batches):
        for c, ((p,), t) in zip(names(), packed(batches, ("p",), CHUNK)):
            ids, v = matrix(t)
            d = distances(np.hstack([v, np.zeros((len(v), 1))]), pivots)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c]), pa.array([p], pa.int32()), pa.array([d.min(0).tolist()], pa.list_(pa.float64())), pa.array([d.max(0).tolist()], pa.list_(pa.float64())),
                 pa.array([LARGE if large else min(LARGE, float((v * v).sum(1).max()))]), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())],
                ["c", "home", "near", "far", "q2", "qids", "qvecs"],
            )

    blocks = cut_lineage(
        sorted_runs(rows, False).mapInArrow(annuli, "a long, p int, lo double, hi double, n long, ids binary, vecs binary, ds binary")
    )
    chunked = cut_lineage(
        sorted_runs(queries.where(F.size("v") == dim), True).mapInArrow(
            chunks, "c long, home int, near array<double>, far array<double>, q2 double, qids binary, qvecs binary"
        )
    )
    directory = blocks.select("a", "p", "lo", "hi", "n")
    spans = chunked.select("c", "home", "q2", F.posexplode(F.arrays_zip("near", "far")).alias("p", "s")).select(
        "c", "home", "q2", "p", F.col("s.near").alias("near"), F.col("s.far").alias("far")
    )
    gap = F.greatest(F.col("near") - F.col("hi"), F.col("lo") - F.col("far"), F.lit(0.0))

    def compare(batches, first):
        """Scores of the rows of one annulus for one chunk that the bounds do not rule out."""
        columns = ["query_id", "vec_id", "score"]
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in b.schema.names}
                qids, ids = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, v = (np.frombuffer(row[n], np.float64).reshape(-1, dim) for n in ("qvecs", "vecs"))
                floor = np.full(len(qids), -np.inf) if first else np.frombuffer(row["floors"], np.float64)
                d = np.frombuffer(row["ds"], np.float64)
                pivot = pivots[row["p"]]
                q2 = (q * q).sum(1)
                free = (q2 >= LARGE) | large  # without bounds
                q2 = np.where(free, 0.0, q2)
                dq = np.where(free, 0.0, np.sqrt(np.maximum(q2 + (pivot * pivot).sum() - 2 * np.where(free[:, None], 0.0, q) @ pivot[:dim], 0)))
                # s = (q2 + m2 - D2) / 2 and D >= |dq - d|; the half covers rounding of integers.
                reach = np.sqrt(np.maximum(q2 + m2 - 2 * (floor - 0.5), 0)) if not first else np.full(len(qids), np.inf)
                reach = np.where(np.isneginf(floor) | free, np.inf, reach * (1 + 1e-9) + 1e-6)
                floor = np.where(np.abs(floor) < 2.0**53, floor, floor - np.abs(floor) * 1e-15)
                floor = np.maximum(floor, float(-(1 << 63)))
                lo, hi = np.searchsorted(d, dq - reach), np.searchsorted(d, dq + reach, side="right")
                out = ([], [], [])
                live = np.flatnonzero(hi > lo)
                if len(live):
                    a, z = int(lo[live].min()), int(hi[live].max())
                    scores = products(q[live], v[a:z])
                    scores[qids[live][:, None] == ids[None, a:z]] = NOTHING
                    for j, s in zip(live, scores):
                        at = best(s, ids[a:z], k)
                        at = at[(s[at] >= floor[j]) & (s[at] > NOTHING)]
                        out[0].append(np.full(len(at), qids[j]))
                        out[1].append(ids[a:z][at])
                        out[2].append(s[at])
                cat = lambda x: np.concatenate(x) if x else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(cat(x).astype(np.int64)) for x in out], columns)

    found = "query_id long, vec_id long, score long"
    # The annuli of the home pivot nearest to the chunk, until k rows (and the query's own) are in.
    home = spans.where(F.col("p") == F.col("home")).join(directory, "p").withColumn("gap", gap)
    upto = F.sum("n").over(Window.partitionBy("c").orderBy("gap", "lo", "a").rowsBetween(Window.unboundedPreceding, -1))
    start = home.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") <= k).select("c", "p", "a")
    seeds = start.join(chunked.select("c", "qids", "qvecs"), "c").join(blocks, ["p", "a"]).mapInArrow(lambda bs: compare(bs, True), found)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    floors = cut_lineage(
        seeds.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
    )

    def unpack(batches):
        for b in batches:
            for r in range(b.num_rows):
                qids = np.frombuffer(b.column("qids")[r].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(qids), b.column("c")[r].as_py())), pa.array(np.arange(len(qids), dtype=np.int32)), pa.array(qids)],
                    ["c", "at", "query_id"],
                )

    members = chunked.select("c", "qids").mapInArrow(unpack, "c long, at int, query_id long")
    lows = (
        members.join(floors, "query_id", "left")
        .groupBy("c")
        .agg(
            F.sort_array(F.collect_list(F.struct("at", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("f")))).alias("fs"),
            F.min(F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf")))).alias("low"),
        )
        .select("c", F.col("fs.f").alias("floors"), "low")
    )
    lows = cut_lineage(lows)
    reach = F.sqrt(F.greatest(F.col("q2") + F.lit(float(m2)) - 2 * (F.col("low") - 0.5), F.lit(0.0))) * (1 + 1e-9) + 1e-6
    reach = F.when(F.col("q2") >= LARGE, float("inf")).otherwise(reach)
    pairs = spans.join(lows.select("c", "low"), "c").join(directory, "p").where(gap <= reach).select("c", "p", "a")

    def with_floors(batches):
        def widen():
            for b in batches:
                floors_ = pa.array([np.array(x, np.float64).tobytes() for x in b.column("floors").to_pylist()], pa.binary())
                yield b.set_column(b.schema.get_field_index("floors"), "floors", floors_)

        yield from compare(widen(), False)

    return (
        pairs.join(chunked.select("c", "qids", "qvecs").join(lows.select("c", "floors"), "c"), "c")
        .join(blocks, ["p", "a"])
        .mapInArrow(with_floors, found)
    )


def whole_numbers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``floor(scale * x)``, as doubles; large ones are whole already and beyond what floor() returns."""
    floor = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    return rows.withColumn("v", F.transform("v", lambda x: floor(x * F.lit(float(scale)))))


def digest(table: DataFrame, k: int = 5) -> DataFrame:
    rows = whole_numbers(clean(table))
    return named(search(rows, asked(rows, 50), k))


SQL = """
WITH v AS (SELECT vec_id, [floor(x::DOUBLE * 256) for x in embedding] AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
