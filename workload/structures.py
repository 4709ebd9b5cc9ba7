"""Sequences and trees: tags, rhythm, phonemes, order lines as symbols and leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from effnum.functions import text as tx
from effnum.operators import graphs, phonology, sequences, trees
from effnum.plans import metrics

from .registry import query, rounded, table

# Longest common subsequence as the textbook recurrence, one list per row.
LCS = """list_last(list_reduce(list_prepend(list_transform(range(0, len(b) + 1), lambda z: 0::BIGINT),
      list_transform(a, lambda u: list_transform(b, lambda v: (u = v)::BIGINT))),
      lambda prev, hit: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(hit) + 1),
        lambda k: [hit[k], prev[k], prev[k + 1]])),
        lambda acc, c: list_append(acc, CASE WHEN c[1] = 1 THEN c[2] + 1 ELSE greatest(c[3], list_last(acc)) END))))"""

ORDER_LINES = """
    WITH seqs AS (SELECT o_orderpriority AS g, o_orderkey AS d,
        list(l_linestatus ORDER BY l_linenumber, l_linestatus) AS s
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    f AS (SELECT g, s, count(*) AS c FROM seqs GROUP BY ALL),
    sizes AS (SELECT g, sum(c) AS n, max(len(s)) AS longest FROM f GROUP BY g)"""

HILL = """
    SELECT g AS o_orderpriority, round(exp(-sum(c / n * ln(z + 1e-10))), 6) AS diversity,
      sum(c)::BIGINT AS n_species FROM zp GROUP BY g"""


def order_lines(spark, folder, column: str = "l_linestatus"):
    """Orders as sequences of a line attribute, by priority."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", column)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    # Lines are gathered by order before the join, so they are moved once and never joined one by one.
    # An order listed several times has its lines as often.
    gathered = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", column)).alias("_l"))
    counted = orders.groupBy("o_orderkey", "o_orderpriority").agg(F.count("*").cast("int").alias("_n"))
    both = counted.join(gathered.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    ordered = F.array_sort(F.when(F.col("_n") == 1, F.col("_l")).otherwise(F.flatten(F.array_repeat("_l", F.col("_n")))))
    return both.select("o_orderpriority", "o_orderkey", ordered[column].alias("tags"))


@query(
    "sequence_hill_orders_by_priority",
    f"""{ORDER_LINES},
    p AS (SELECT x.g, x.s AS a, y.s AS b, y.c AS cb FROM f x JOIN f y ON x.g = y.g AND x.s <> y.s),
    o AS (SELECT g, a, sum(cb * {LCS}) AS other FROM p GROUP BY ALL),
    zp AS (SELECT f.g, f.c, n, (1 + (c - 1) * len(s) / longest + coalesce(other, 0) / longest) / n AS z
      FROM f JOIN sizes USING (g) LEFT JOIN o ON o.g = f.g AND o.a = f.s){HILL}""",
)
def sequence_hill_orders(spark, folder):
    out = sequences.sequence_diversity(order_lines(spark, folder), ["o_orderpriority"], "tags")
    return rounded(out.select("o_orderpriority", "diversity", "n_species"), "diversity")


@query("sequence_hill_line_flags_by_priority")
def sequence_hill_flags(spark, folder):
    rows = order_lines(spark, folder, "l_returnflag")
    return rounded(sequences.sequence_diversity(rows, ["o_orderpriority"], "tags"), "diversity")


@query("sequence_hill_padded_by_priority")
def sequence_hill_padded(spark, folder):
    out = sequences.sequence_diversity(order_lines(spark, folder), ["o_orderpriority"], "tags", pad="NULL")
    return rounded(out, "diversity")


@query("pos_shape_hill_by_conversation")
def pos_shape_hill(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", tx.shape_tags("text").alias("tags"))
    return rounded(sequences.sequence_diversity(turns, ["conv_id"], "tags"), "diversity")


@query("pos_shape_hill_by_source")
def pos_shape_hill_by_source(spark, folder):
    """Whole documents, hundreds to thousands of words each."""
    docs = table(spark, folder, "documents").select("source", "doc_id", tx.shape_tags("text").alias("tags"))
    return rounded(sequences.sequence_diversity(docs, ["source"], "tags"), "diversity")


@query("rhythmic_hill_by_conversation")
def rhythmic_hill(spark, folder):
    turns = table(spark, folder, "conversations")
    return rounded(phonology.rhythmic_diversity(turns, ["conv_id"], "turn"), "diversity")


@query("rhythmic_sentences_hill_by_conversation")
def rhythmic_sentences_hill(spark, folder):
    turns = table(spark, folder, "conversations")
    return rounded(phonology.rhythmic_diversity(turns, ["conv_id"], "turn", split_sentences=True), "diversity")


@query("phonemic_hill_by_conversation")
def phonemic_hill(spark, folder):
    turns = table(spark, folder, "conversations")
    return rounded(phonology.phonemic_diversity(turns, ["conv_id"], "turn"), "diversity")


def order_trees(spark, folder):
    """Orders as trees: the order above its lines, labelled by line status."""
    # Line numbers repeat within an order, so a line's node is its place in the sorted list.
    lines = order_lines(spark, folder)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    roots = orders.select(
        "o_orderpriority",
        "o_orderkey",
        F.lit(0).alias("node"),
        F.lit(None).cast("int").alias("parent"),
        F.lit("ORDER").alias("label"),
    )
    leaves = lines.select("o_orderpriority", "o_orderkey", F.posexplode("tags").alias("_i", "label")).select(
        "o_orderpriority", "o_orderkey", (F.col("_i") + 1).alias("node"), F.lit(0).alias("parent"), "label"
    )
    return roots.unionByName(leaves)


@query(
    "tree_hill_orders_by_priority",
    """
    WITH seqs AS (SELECT o_orderpriority AS g, o_orderkey AS d,
        coalesce(string_agg(l_linestatus, '' ORDER BY l_linenumber, l_linestatus), '') AS s
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    f AS (SELECT g, s, count(*) AS c FROM seqs GROUP BY ALL),
    sizes AS (SELECT g, sum(c) AS n FROM f GROUP BY g),
    zp AS (SELECT x.g, any_value(x.c) AS c, any_value(n) AS n,
        sum(y.c * exp(-levenshtein(x.s, y.s))) / any_value(n) AS z
      FROM f x JOIN f y USING (g) JOIN sizes USING (g) GROUP BY x.g, x.s)"""
    + HILL,
)
def tree_hill_orders(spark, folder):
    """Two-level trees with a common root: their edit distance is that of the leaves."""
    out = trees.constituency_diversity(order_trees(spark, folder), ["o_orderpriority"], "o_orderkey")
    return rounded(out.select("o_orderpriority", "diversity", "n_species"), "diversity")


@query(
    "tree_shape_hill_orders_by_priority",
    """
    WITH seqs AS (SELECT o_orderpriority AS g, o_orderkey, count(l_orderkey) AS s
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    f AS (SELECT g, s, count(*) AS c FROM seqs GROUP BY ALL),
    sizes AS (SELECT g, sum(c) AS n FROM f GROUP BY g),
    zp AS (SELECT x.g, any_value(x.c) AS c, any_value(n) AS n,
        sum(y.c * exp(-abs(x.s - y.s))) / any_value(n) AS z
      FROM f x JOIN f y USING (g) JOIN sizes USING (g) GROUP BY x.g, x.s)"""
    + HILL,
)
def tree_shape_hill_orders(spark, folder):
    out = trees.constituency_diversity(
        order_trees(spark, folder), ["o_orderpriority"], "o_orderkey", label_mode="shape"
    )
    return rounded(out.select("o_orderpriority", "diversity", "n_species"), "diversity")


@query("dependency_hill_by_conversation")
def dependency_hill(spark, folder):
    turns = table(spark, folder, "conversations").withColumn("doc_id", F.col("turn"))
    parses = metrics.head_first_parses(turns, ["conv_id"])
    return rounded(trees.dependency_diversity(parses, ["conv_id"]), "diversity")


@query("constituency_hill_by_conversation")
def constituency_hill(spark, folder):
    turns = table(spark, folder, "conversations").withColumn("doc_id", F.col("turn"))
    return rounded(trees.constituency_diversity(metrics.chunk_trees(turns, ["conv_id"]), ["conv_id"]), "diversity")


@query(
    "degree_profile_by_order",
    """
    WITH k AS (SELECT o_orderkey, count(l_orderkey)::DOUBLE AS k FROM orders
      LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    nodes AS (
      SELECT o_orderkey, [k, CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END, CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END,
        CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END, 0.0] AS s, 1 AS c FROM k
      UNION ALL SELECT o_orderkey, [1.0, k, k, k, 0.0], k FROM k WHERE k > 0),
    slots AS (SELECT o_orderkey, c, unnest(range(0, 5)) AS i, unnest(s) AS x FROM nodes)
    SELECT o_orderkey, (i * 64 + least(floor(ln(1 + x) / 10.0 * 64), 63))::INTEGER AS slot,
      sum(c)::DOUBLE AS n FROM slots GROUP BY ALL""",
)
def degree_profile(spark, folder):
    vectors = graphs.local_degree_profile(order_trees(spark, folder), [], "o_orderkey")
    slots = vectors.select("o_orderkey", F.posexplode("vec").alias("slot", "n"))
    return slots.where(F.col("n") > 0)


@query("degree_profile_hill_by_conversation")
def degree_profile_hill(spark, folder):
    turns = table(spark, folder, "conversations").withColumn("doc_id", F.col("turn"))
    edges = metrics.chunk_trees(turns, ["conv_id"])
    return rounded(trees.constituency_diversity(edges, ["conv_id"], similarity="ldp"), "diversity")


@query(
    "feather_by_order",
    """
    WITH k AS (SELECT o_orderkey, count(l_orderkey)::DOUBLE AS k FROM orders
      LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    w AS (SELECT o_orderkey, k, r, p, t, 2.5 * (t + 1) / 4 AS theta
      FROM k, (SELECT unnest([1, 2]) AS r), (SELECT unnest([0, 1]) AS p), (SELECT unnest([0, 1, 2, 3]) AS t)),
    ends AS (SELECT *, CASE p WHEN 0 THEN cos(theta * ln(1 + k)) ELSE sin(theta * ln(1 + k)) END AS hub,
      CASE p WHEN 0 THEN cos(theta * ln(2.0)) ELSE sin(theta * ln(2.0)) END AS leaf FROM w)
    SELECT o_orderkey, ((r - 1) * 8 + p * 4 + t)::INTEGER AS place,
      round(CASE WHEN k = 0 THEN 0.0 WHEN r = 1 THEN (leaf + k * hub) / (k + 1)
        ELSE (hub + k * leaf) / (k + 1) END, 6) AS value FROM ends""",
)
def feather_waves(spark, folder):
    vectors = graphs.feather(order_trees(spark, folder), [], "o_orderkey", order=2, points=4)
    return rounded(vectors.select("o_orderkey", F.posexplode("vec").alias("place", "value")), "value")


@query("feather_hill_by_conversation")
def feather_hill(spark, folder):
    turns = table(spark, folder, "conversations").withColumn("doc_id", F.col("turn"))
    edges = metrics.chunk_trees(turns, ["conv_id"])
    return rounded(trees.constituency_diversity(edges, ["conv_id"], similarity="feather"), "diversity")
