"""Approximate nearest neighbours (largest inner product) with random-projection trees.

Each tree splits by the difference of two random rows at the median; the trees are grown
on a bounded sample (``SAMPLE`` rows), and every row goes into one leaf of each tree. A
query walks all trees with one shared priority queue ordered by its distance from the
borders it did not cross, until it has visited a given share of the leaves, and on until
they are sure to hold k candidates (sampled rows are counted) or none is left. Candidates
of the visited leaves are scored exactly on the original vectors, and a row found in
several trees counts once. Vectors are lifted by one coordinate for the trees, so that
rows of different length are found by inner product too.

Rows are stored by tree and subtree in blocks of bounded size, and queries are sent to
the subtrees they visit in packed chunks; tasks join blocks with chunks, so a leaf with a
third of all rows is many blocks. ``VISITS`` is set for a recall of 0.9 and more even
where vectors have no structure at all; with structure fewer leaves would do.

Defined cases: vectors null, empty, zero or with null or non-finite components take no
part; repeated rows are candidates each for itself, and ask once; rows without an id are
candidates (after all others among equals, null in the result) and never ask; of one id
with several vectors the query's ranks are those of all its vectors together; vectors are
compared with those of the same length, each length by a forest of its own; with fewer candidates than k
all are returned; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mixed
from .topk_pivot import lifted
from .vectors import asked, best, clean, lengths, matrix, named, packed, sample

SAMPLE = 20_000
TREES = 8
DEPTH = 8  # at most 2**DEPTH leaves a tree
LEAF = 8  # sampled rows below which a node is not split
SUBTREES = 3  # levels that name a subtree
VISITS = 0.15  # share of all leaves that a query visits
BLOCK = 4096  # rows of a block
CHUNK = 256  # queries of a chunk
FOUND = "query_id long, vec_id long, pair long, score double, tree int"


class Forest:
    """Node arrays of all trees; negative children are leaves, numbered over the forest."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = 11, ids: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.normals, self.cuts, self.children, self.roots = [], [], [], []
        self.tree_of, self.shard_of = [], []
        for t in range(trees):
            self.roots.append(self._grow(x, np.arange(len(x)), 0, t, 0, rng))
        self.normals = np.array(self.normals).reshape(-1, x.shape[1])
        self.cuts = np.array(self.cuts, np.float64)
        self.tree_of, self.shard_of = np.array(self.tree_of), np.array(self.shard_of)
        # Sampled ids of every leaf; an id counts with one of its rows only.
        one = x if ids is None else x[np.unique(ids, return_index=True)[1]]
        self.held = np.bincount(self.leaves(one).ravel(), minlength=len(self.tree_of)).tolist()

    def _grow(self, x, rows, depth, tree, path, rng) -> int:
        if depth < DEPTH and len(rows) > LEAF:
            for _ in range(4):
                a, b = x[rng.choice(rows, 2, replace=False)]
                w = a - b
                size = np.sqrt(w @ w)
                if not size:
                    continue
                side = x[rows] @ (w / size)
                cut = np.median(side)
                left, right = rows[side <= cut], rows[side > cut]
                if len(left) and len(right):
                    me = len(self.children)
                    self.normals.append(w / size)
                    self.cuts.append(cut)
                    self.children.append(None)
                    down = lambda bit: path * 2 + bit if depth < SUBTREES else path
                    self.children[me] = (
                        self._grow(x, left, depth + 1, tree, down(0), rng),
                        self._grow(x, right, depth + 1, tree, down(1), rng),
                    )
                    return me
        self.tree_of.append(tree)
        self.shard_of.append(path)
        return -len(self.tree_of)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            stack = [(root, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if node < 0:
                    out[rows, t] = -node - 1
                elif len(rows):
                    side = x[rows] @ self.normals[node] <= self.cuts[node]
                    stack += [(self.children[node][0], rows[side]), (self.children[node][1], rows[~side])]
        return out

    def visit(self, x: np.ndarray, leaves: int, ids: int = 0) -> list[list[int]]:
        """For every query the leaves it visits, nearest borders first over all trees.

        It goes on until the leaves of one tree, which share no row, hold ``ids`` sampled ids.
        """
        margins = x @ self.normals.T - self.cuts if len(self.cuts) else np.zeros((len(x), 0))
        out = []
        for m in margins.tolist():
            queue = [(0.0, root) for root in self.roots]
            heapq.heapify(queue)
            own: list[int] = []
            seen = [0] * len(self.roots)
            while queue and (len(own) < leaves or max(seen) < ids):
                away, node = heapq.heappop(queue)
                while node >= 0:
                    s = m[node]
                    near, far = self.children[node] if s <= 0 else self.children[node][::-1]
                    heapq.heappush(queue, (max(away, abs(s)), far))
                    node = near
                own.append(-node - 1)
                seen[self.tree_of[own[-1]]] += self.held[own[-1]]
            out.append(own)
        return out


def search(rows: DataFrame, queries: DataFrame, k: int, visits: float = VISITS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest inner products found per query."""
    found = SparkSession.active().createDataFrame([], FOUND)
    for dim, total, m2 in lengths(rows):
        found = found.union(_of_length(rows.where(F.size("v") == dim), queries, k, visits, dim, total, m2))
    # A pair of rows may be found in several trees; in each of them repeated rows share a leaf.
    in_tree = found.groupBy("query_id", "vec_id", "pair", "tree").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    once = in_tree.groupBy("query_id", "vec_id", "pair").agg(F.max("score").alias("score"), F.least(F.max("n"), F.lit(k)).cast("int").alias("n"))
    once = once.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        once.withColumn("rank", F.row_number().over(ranked).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _marks(v: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row of a matrix; tells an id's vectors apart."""
    bits = np.ascontiguousarray(v + 0.0).view(np.uint64)
    return mixed(mixed(bits + np.arange(1, v.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(1, dtype=np.uint64))


def _of_length(rows: DataFrame, queries: DataFrame, k: int, visits: float, dim: int, total: int, m2: float) -> DataFrame:
    """``query_id, vec_id, pair, score`` of what is found among ``rows`` of one length."""
    spark = SparkSession.active()
    ids, drawn = sample(rows, SAMPLE, total)
    grown = Forest(lifted(drawn, m2), ids=ids)
    forest = spark.sparkContext.broadcast(grown)  # bounded by SAMPLE, TREES and DEPTH
    leaves = max(TREES, int(np.ceil(visits * len(grown.tree_of))))

    def index(batches):
        f = forest.value
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            at = f.leaves(lifted(v, m2))
            for t in range(at.shape[1]):
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("v"), pa.array(f.tree_of[at[:, t]].astype(np.int32)), pa.array(f.shard_of[at[:, t]].astype(np.int32)), pa.array(at[:, t])],
                    ["id", "v", "tree", "shard", "leaf"],
                )

    def blocks(batches):
        for (tree, shard), t in packed(batches, ("tree", "shard"), BLOCK):
            ids, v = matrix(t)
            leaf = t.column("leaf").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree], pa.int32()), pa.array([shard], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([v.tobytes()], pa.binary()), pa.array([leaf.tobytes()], pa.binary())],
                ["tree", "shard", "ids", "vecs", "leaf"],
            )

    def walks(batches):
        f = forest.value
        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK):
                b = whole.slice(lo, CHUNK)
                ids = b.column("id").to_numpy(zero_copy_only=False)
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
                seen = f.visit(np.hstack([v, np.zeros((len(v), 1))]), leaves, k + 1)
                who = np.repeat(np.arange(len(seen)), [len(s) for s in seen])
                what = np.concatenate(seen).astype(np.int64)
                place = f.tree_of[what] << SUBTREES | f.shard_of[what]
                out = ([], [], [], [], [], [])
                for p in np.unique(place):
                    here = place == p
                    q, mine = np.unique(who[here], return_inverse=True)
                    cells = (int(p) >> SUBTREES, int(p) & ((1 << SUBTREES) - 1), ids[q].tobytes(), v[q].tobytes(), mine.astype(np.int32).tobytes(), what[here].astype(np.int32).tobytes())
                    for column, x in zip(out, cells):
                        column.append(x)
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["tree", "shard", "qids", "qvecs", "who", "what"])

    def compare(batches):
        """The k best rows of one block for every query of one chunk, among the leaves it visits."""
        for b in batches:
            for r in range(b.num_rows):
                get = lambda n, t: np.frombuffer(b.column(n)[r].as_py(), t)  # noqa: B023, E731
                qids, ids, who, what, leaf = get("qids", np.int64), get("ids", np.int64), get("who", np.int32), get("what", np.int32), get("leaf", np.int32)
                q, v = get("qvecs", np.float64).reshape(-1, dim), get("vecs", np.float64).reshape(-1, dim)
                order = np.argsort(what, kind="stable")
                who, what = who[order], what[order]
                tops: dict[int, list] = {}
                for low in np.unique(leaf):
                    a, z = np.searchsorted(leaf, low), np.searchsorted(leaf, low, side="right")
                    mine = who[np.searchsorted(what, low) : np.searchsorted(what, low, side="right")]
                    if not len(mine):
                        continue
                    for j, s in zip(mine.tolist(), q[mine] @ v[a:z].T):
                        tops.setdefault(j, []).append((a, z, s))
                out = ([], [], [], [], [])
                for j, parts in tops.items():
                    s = np.concatenate([x for _, _, x in parts])
                    own = np.concatenate([ids[a:z] for a, z, _ in parts])
                    place = np.concatenate([np.arange(a, z) for a, z, _ in parts])
                    s = np.where(own == qids[j], -np.inf, s)
                    at = best(s, own, k)
                    at = at[np.isfinite(s[at])]
                    # One product per pair, so that a pair scores alike in every tree.
                    exact = (v[place[at]] * q[j]).sum(1)
                    out[0].append(np.full(len(at), qids[j]))
                    out[1].append(own[at])
                    out[2].append((_marks(v[place[at]]) + mixed(_marks(q[[j]]))).view(np.int64))
                    out[3].append(exact)
                    out[4].append(np.full(len(at), b.column("tree")[r].as_py(), np.int32))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "pair", "score", "tree"])

    stored = (
        rows.mapInArrow(index, "id long, v array<double>, tree int, shard int, leaf int")
        .repartitionByRange("tree", "shard", "leaf", "id")
        .sortWithinPartitions("tree", "shard", "leaf", "id")
        .mapInArrow(blocks, "tree int, shard int, ids binary, vecs binary, leaf binary")
    )
    sent = queries.where(F.size("v") == dim).mapInArrow(
        walks, "tree int, shard int, qids binary, qvecs binary, who binary, what binary"
    )
    return sent.join(stored, ["tree", "shard"]).mapInArrow(compare, FOUND)


def digest(table: DataFrame, k: int = 20) -> DataFrame:
    rows = clean(table, zero=False)
    return named(search(rows, asked(rows, 20), k))
