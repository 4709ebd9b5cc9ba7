"""A Merkle manifest of a corpus: one root, and a proof for every document.

A document is a leaf: the SHA-256 of its fields, each written as its length and its
value. The leaves of a source, in the order of their ids, are hashed three by three
until one node, the subroot, is left; the subroots of all sources, in the order of
their names, are hashed in the same way up to the root.

Trees are built in few rounds: ``LEVELS`` levels at a time, a task hashes a run of at
most ``3 ** LEVELS`` neighbouring nodes, which is a bounded group whatever the size of
its source. Proofs come from pointer jumping. Every node holds a segment, the siblings
between itself and an ancestor, at first its parent. A self-join replaces each
ancestor by the ancestor's own ancestor and puts the two segments together, so the
distance doubles, and after a logarithmic number of joins every leaf reaches the root.
Only nodes high enough can be such an ancestor, so the far side of a join shrinks with
the distance, and it is salted as the number of nodes below one ancestor grows.

Texts are hashed where they are read and never shuffled; nodes and segments carry raw
digests of 32 bytes. State is written to the checkpoint folder after each round.

Defined cases: a null field is hashed as a dash, an empty one is a value of length 0;
a null id comes before all others and is never tampered with; rows that share an id
come in the order of their leaves, so repeated rows have proofs of their own; a null
source is a source of its own, the first one; a source of one document has its leaf as
subroot, and a corpus of one source its subroot as root; an empty table has no rows;
texts of any length are hashed whole; columns other than the five fields are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..operators.ordinals import ordinal
from ..session import cut_lineage, partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 3  # nodes below one parent
LEVELS = 6  # levels that a task builds at a time
SALT_FROM = 81  # nodes that one ancestor may meet in a join before its row is salted
TOP = "t"  # the tree of the subroots; names of sources start with an s, the null one is empty

ABOVE = 64  # marks the steps that lie above a subroot

_SHAPE = "k string, l int, i long, h int, d binary, seg binary, pk string, pl int, pi long, top boolean"
_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.bool_())


def field(value: Column) -> Column:
    """A value as it is hashed: length in bytes, a colon and the value; a dash for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The digest of a document (32 bytes); ``changed`` gives other values for some fields."""
    return F.unhex(F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256))


def _hash(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def levels_of(first: int, nodes: list[bytes], heights: list[int], whole: bool, most: int = LEVELS):
    """The nodes above a run of neighbours that starts at place ``first``, level by level.

    Yields, for each level, the first place, digests, heights and one-step segments of its nodes, and
    at last what is left, with None for the segments. ``whole``: the run is all that the tree has, so
    it ends with one node; otherwise it goes up by ``most`` levels.

    A step of a segment is a byte (the own place times RUN, plus the number of siblings) and the
    siblings' digests from left to right.
    """
    level = 0
    while (len(nodes) > 1) if whole else (level < most):
        segments, up, height = [], [], []
        for a in range(0, len(nodes), RUN):
            run = nodes[a : a + RUN]
            segments += [bytes([j * RUN + len(run) - 1]) + b"".join(run[:j] + run[j + 1 :]) for j in range(len(run))]
            up.append(_hash(run))
            height.append(max(heights[a : a + RUN]) + 1)
        yield level, first, nodes, heights, segments
        nodes, heights, first, level = up, height, first // RUN, level + 1
    yield level, first, nodes, heights, None


def _grown(nodes: DataFrame, base: int) -> DataFrame:
    """Up to LEVELS levels above ``nodes`` (k, i, h, d), which lie on level ``base`` of their trees.

    Nodes below have a segment and a parent; what is left has neither, and is marked if it is the top.
    """
    most = LEVELS
    g = F.floor(F.col("i") / F.lit(RUN**most)).alias("g")
    runs = nodes.groupBy("k", g).agg(F.sort_array(F.collect_list(F.struct("i", "d", "h"))).alias("run"))

    def build(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for k, run in zip(b.column("k").to_pylist(), b.column("run")):
                run = run.as_py()
                first = run[0]["i"]
                # A shorter run is a tree's last one: at place 0 it is the only one. A full one that
                # is the only one ends after LEVELS levels all the same.
                whole = first == 0 and len(run) < RUN**most
                out = []
                for level, at, digests, heights, segments in levels_of(first, [x["d"] for x in run], [x["h"] for x in run], whole, most):
                    for j, (d, h) in enumerate(zip(digests, heights)):
                        up = (None, None, None, None) if segments is None else (segments[j], k, base + level + 1, (at + j) // RUN)
                        out.append((k, base + level, at + j, h, d, *up, segments is None and whole))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], [x.split()[0] for x in _SHAPE.split(", ")])

    return runs.select("k", "run").mapInArrow(build, _SHAPE)


def trees(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trees over ``leaves`` (k: tree, i: place, h: height, d: digest).

    Returns all nodes with a parent, ``k, l, i, h, seg, pk, pl, pi`` (id, height, segment, parent), and the
    tops, ``k, l, i, h, d``.
    """
    below, tops, base = None, None, 0
    while True:
        grown = cut_lineage(_grown(leaves, base))
        part = grown.where(F.col("seg").isNotNull()).select("k", "l", "i", "h", "seg", "pk", "pl", "pi")
        done = grown.where("top").select("k", "l", "i", "h", "d")
        below, tops = (part, done) if below is None else (below.union(part), tops.union(done))
        leaves = grown.where(F.col("seg").isNull() & ~F.col("top")).select("k", "i", "h", "d")
        if leaves.isEmpty():
            return below, tops
        base += LEVELS


def forest(leaves: DataFrame) -> tuple[DataFrame, Row | None]:
    """All nodes with a parent up to the root of all trees, and the root (k, l, i, h, d); None without leaves."""
    below, tops = trees(leaves)
    # The tops, in the order of their trees, are the leaves of one more tree; there they keep their ids.
    placed = cut_lineage(ordinal(tops, [], ["k"], "t"))
    above, last = trees(placed.select(F.lit(TOP).alias("k"), F.col("t").alias("i"), "h", "d"))
    root = last.first()
    if root is None:
        return below, None
    # A flag in the first byte of a step tells where the segment leaves the tree of its source.
    header = F.conv(F.hex(F.substring("seg", 1, 1)), 16, 10).cast("int") + ABOVE
    marked = above.withColumn("seg", F.concat(F.unhex(F.lpad(F.hex(header), 2, "0")), F.expr("substring(seg, 2)")))
    ids = placed.select(F.col("k").alias("nk"), F.col("l").alias("nl"), F.col("i").alias("ni"), F.col("t").alias("i"))
    low = marked.where(F.col("l") == 0).join(ids, "i").select(F.col("nk").alias("k"), F.col("nl").alias("l"), F.col("ni").alias("i"), "h", "seg", "pk", "pl", "pi")
    if root["l"] == 0:  # one tree only: its top is the root
        root = placed.select("k", "l", "i", "h", "d").first()
    return below.union(low).union(marked.where(F.col("l") > 0)), root


def _jump(todo: DataFrame, far: DataFrame, fan: int) -> DataFrame:
    """``todo`` with the segments and pointers of the ancestors it points to; ``fan`` nodes at most point to one."""
    salts = max(1, min(4 * partitions(todo), fan // SALT_FROM))
    right = far.select(
        F.col("k").alias("pk"), F.col("l").alias("pl"), F.col("i").alias("pi"), F.col("seg").alias("rest"),
        F.col("pk").alias("nk"), F.col("pl").alias("nl"), F.col("pi").alias("ni"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    left = todo.withColumn("salt", F.pmod(F.xxhash64("k", "l", "i"), F.lit(salts)).cast("int"))
    return left.join(right, ["pk", "pl", "pi", "salt"]).select(
        "k", "l", "i", "h", F.concat("seg", "rest").alias("seg"), F.col("nk").alias("pk"), F.col("nl").alias("pl"), F.col("ni").alias("pi")
    )


def proofs(nodes: DataFrame, root: Row) -> DataFrame:
    """``k, i, seg``: every leaf's siblings up to the root, by pointer jumping. The root as a leaf has no row."""
    arrived = (F.col("pk") == root["k"]) & (F.col("pl") == root["l"]) & (F.col("pi") == root["i"])
    is_leaf = (F.col("l") == 0) & (F.col("k") != TOP)
    state, distance, fan, done = nodes, 1, RUN, []
    while distance < root["h"]:
        done.append(state.where(is_leaf & arrived))
        # An ancestor at this distance is at least this high; after the join, twice as high.
        later = F.col("h") >= 2 * distance
        moved = _jump(state.where(~arrived & (is_leaf | later)), state.where(F.col("h") >= distance), fan)
        state = moved.union(state.where(arrived & later).select(moved.columns))
        distance, fan = 2 * distance, fan * fan
        if distance < root["h"]:
            state = cut_lineage(state)
    return reduce(DataFrame.union, [part.select("k", "i", "seg") for part in (state.where(is_leaf), *done)])


def steps(segment: bytes) -> Iterator[tuple[bool, int, list[bytes]]]:
    """A proof level by level: whether it lies above the subroot, the place among the siblings, and these."""
    at = 0
    while at < len(segment):
        place, many = divmod(segment[at] % ABOVE, RUN)
        yield segment[at] >= ABOVE, place, [segment[at + 1 + 32 * j : at + 33 + 32 * j] for j in range(many)]
        at += 1 + 32 * many


def fold(leaf_digest: bytes, segment: bytes) -> tuple[bytes, bytes]:
    """Subroot and root that a leaf and its proof lead to."""
    now, subroot = leaf_digest, None
    for above, place, others in steps(segment):
        if above and subroot is None:
            subroot = now
        now = _hash([*others[:place], now, *others[place:]])
    return (now if subroot is None else subroot), now


def order_key(source: str) -> Column:
    """Names in UTF-8 order, null first."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit(""))


def manifest(docs: DataFrame, tampered: Column | None = None) -> tuple[DataFrame, Row | None]:
    """``doc_id, k, i, leaf, other, seg`` of every row, and the root node.

    k and i: tree of the source and place in it; ``seg`` the proof (null if the leaf is the root);
    ``other`` the leaf of the row if its text were ``tampered`` (null where that is null).
    """
    other = F.lit(None).cast("binary") if tampered is None else F.when(tampered.isNotNull(), leaf(text=tampered))
    narrow = docs.select("doc_id", order_key("source").alias("k"), leaf().alias("leaf"), other.alias("other"))
    rows = cut_lineage(ordinal(narrow, ["k"], ["doc_id", "leaf"], "i"))
    nodes, root = forest(rows.select("k", "i", F.lit(0).alias("h"), F.col("leaf").alias("d")))
    if root is None:
        return rows.withColumn("seg", F.lit(None).cast("binary")), None
    return rows.join(proofs(nodes, root), ["k", "i"], "left"), root


def checked(rows: DataFrame, root: Row | None) -> DataFrame:
    """Folds every proof of ``manifest`` from the row's other leaf, or its own if there is none."""
    top = bytes(root["d"]) if root else b""
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = []
            for own, other, seg in zip(*(b.column(c).to_pylist() for c in ("leaf", "other", "seg"))):
                seg = seg or b""
                subroot, found = fold(own, seg)
                if other is not None:
                    found = fold(other, seg)[1]
                proof = "".join(d.hex() for _, _, ds in steps(seg) for d in ds)
                out.append((own.hex(), subroot.hex(), top.hex(), hashlib.sha256(proof.encode()).hexdigest(), found.hex(), found == top))
            columns = [pa.array(c) for c in zip(*out)] if out else [pa.array([], pa.string())] * 5 + [pa.array([], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], list(names))

    shape = f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{n} string" for n in names[1:-1]) + ", verified boolean"
    return rows.select("doc_id", "leaf", "other", "seg").mapInArrow(run, shape)


def digest(docs: DataFrame) -> DataFrame:
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows, root = manifest(docs, F.when(half, F.translate("text", "\n", "")))
    return checked(rows, root)


def _leaf_sql(text: str = "text") -> str:
    parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in (*FIELDS[:-1], text)]
    return f"sha256({' || '.join(parts)})"


SQL = f"""
WITH RECURSIVE crc AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 0 AS p, 4294967295::BIGINT AS x FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, p + 1, xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT
  FROM (SELECT doc_id, s, p, CASE WHEN p % 8 = 0 THEN xor(x, ascii(s[p // 8 + 1])::BIGINT) ELSE x END AS y FROM crc WHERE p < 8 * length(s))),
half AS (SELECT doc_id FROM crc WHERE p = 8 * length(s) AND x & 1 = 1),
h AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS k, {_leaf_sql()} AS leaf,
    CASE WHEN doc_id IN (SELECT doc_id FROM half) THEN {_leaf_sql("replace(text, chr(10), '')")} END AS bad FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM h),
low AS (SELECT k, 0 AS l, i, leaf AS d, n FROM leaves
  UNION ALL SELECT k, l + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY k, l, i // 3, n),
sub AS (SELECT k, d, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS l, i, d, n FROM sub
  UNION ALL SELECT l + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY l, i // 3, n),
nodes AS (SELECT k, l, i, d FROM low WHERE n > 1 UNION ALL SELECT 't', l, i, d FROM high WHERE n > 1),
sides AS (SELECT a.k, a.l, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS bef,
    coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS aft
  FROM nodes a JOIN nodes b ON a.k = b.k AND a.l = b.l AND a.i // 3 = b.i // 3 GROUP BY a.k, a.l, a.i),
walk AS (SELECT r, k, 0 AS l, i, '' AS p, coalesce(bad, leaf) AS d FROM leaves
  UNION ALL SELECT r, w.k, w.l + 1, w.i // 3, p || bef || aft, sha256(bef || d || aft) FROM walk w JOIN sides s ON w.k = s.k AND w.l = s.l AND w.i = s.i),
mid AS (SELECT r, k, arg_max(p, l) AS p, arg_max(d, l) AS d FROM walk GROUP BY r, k),
on_top AS (SELECT r, 0 AS l, sub.i, mid.p, mid.d FROM mid JOIN sub USING (k)
  UNION ALL SELECT r, w.l + 1, w.i // 3, p || bef || aft, sha256(bef || d || aft) FROM on_top w JOIN sides s ON s.k = 't' AND w.l = s.l AND w.i = s.i),
ends AS (SELECT r, arg_max(p, l) AS p, arg_max(d, l) AS d FROM on_top GROUP BY r)
SELECT doc_id, leaf, sub.d AS subroot, high.d AS root, sha256(ends.p) AS proof_sha256, ends.d AS folded_root, ends.d = high.d AS verified
FROM leaves JOIN sub USING (k) JOIN ends USING (r) JOIN high ON high.n = 1"""
