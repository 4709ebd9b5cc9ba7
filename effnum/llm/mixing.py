"""Mixing sources to target weights by capped water-filling.

Every source gets a share of all words by its weight; a share above ``max_epochs`` times
the source's own size is clamped there, and the excess goes to the others by weight, in
rounds over the per-source totals, until none is above. A source with ratio r (target by
size) is taken floor(r) times as a whole, and once more in part: its documents in a
seeded md5 order up to the remaining words, rounded to the nearer document.

The order is never sorted as a whole: sizes are summed per source and slice of the md5
space (pre-aggregated), and only the one slice per source that holds the cut is ordered.
Documents are then compared with their source's cut: by broadcast where the sources are
few, else in a salted join, which then shuffles the texts.

Defined cases: a null source is a source of its own, last in order; a null text has size
0; sources without words have target 0 and nothing taken; rows that share an id share
their fate; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordinals import ordinal
from ..session import cut_lineage, stable_order
from .common import WORD

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 7
SALTS = 32
DIGITS = 3  # hex digits of the md5 order that name a slice


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``src, source_size, target`` from rows of ``src, size``."""
    totals = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    ranked = ordinal(totals, [], [F.col("src").asc_nulls_last()], "at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    table = cut_lineage(
        ranked.select("src", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    )
    level, clamped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("cap") <= F.col("w") * F.lit(level)
        row = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["all"] is None or row["n"] == clamped or not row["w"]:
            break
        clamped, level = row["n"], (row["all"] - row["held"]) / row["w"]
    return table.select(
        "src", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(0.0 if level is None else level)).alias("target")
    )


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` with ``__llm_size, __llm_source_size, __llm_target, __llm_copies`` (how often the mix takes the document)."""
    narrow = cut_lineage(docs.select(F.col(source).alias("src"), n_words(text).alias("size"), stable_order(seed, doc_id).alias("o")))
    plan = cut_lineage(
        targets(narrow)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    slice_ = F.substring("o", 1, DIGITS)
    sums = narrow.groupBy("src", slice_.alias("s")).agg(F.sum("size").alias("c"))
    before = Window.partitionBy("src").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0)))
    p, b = plan.alias("p"), base.alias("b")
    # The last slice that starts at or before the remaining words holds the cut.
    edge = (
        b.join(p, F.col("b.src").eqNullSafe(F.col("p.src")))
        .where(F.col("b.base") <= F.col("p.rest"))
        .groupBy(F.col("b.src").alias("src"))
        .agg(F.max(F.struct("s", "base", "rest")).alias("e"))
        .select("src", "e.s", "e.base", "e.rest")
    )
    n, e = narrow.alias("n"), edge.alias("e")
    inside = n.join(e, F.col("n.src").eqNullSafe(F.col("e.src")) & (F.substring("n.o", 1, DIGITS) == F.col("e.s"))).select(
        "n.src", "n.o", "n.size", "e.s", "e.base", "e.rest"
    )
    same = inside.groupBy("src", "s", "o").agg(F.sum("size").alias("c"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    upto = F.sum("c").over(Window.partitionBy("src").orderBy("o"))
    taken = (F.col("base") + F.col("upto") - F.col("c") / 2) <= F.col("rest")
    cut = same.withColumn("upto", upto).groupBy("src").agg(F.max(F.when(taken, F.col("o"))).alias("cut"), F.first("s").alias("s"))
    cuts = (
        plan.alias("p")
        .join(cut.alias("c"), F.col("p.src").eqNullSafe(F.col("c.src")), "left")
        # A slice where nothing is taken ends just before its first document.
        .select(F.col("p.src").alias("__llm_src"), "source_size", "target", "whole", F.coalesce("c.cut", "c.s", F.lit("")).alias("__llm_cut"))
        .withColumnsRenamed({"source_size": "__llm_source_size", "target": "__llm_target", "whole": "__llm_whole"})
    )
    # A source with a third of all documents meets its cut in SALTS parts.
    spread = cuts.withColumn("__llm_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = docs.withColumns({"__llm_size": n_words(text), "__llm_salt": F.pmod(F.xxhash64(doc_id, text), F.lit(SALTS))})
    out = salted.join(spread, (F.col("__llm_salt") == F.col("__llm_part")) & F.col(source).eqNullSafe(F.col("__llm_src")), "left")
    extra = (stable_order(seed, doc_id) <= F.col("__llm_cut")).cast("long")
    # Texts of size 0 before the cut add nothing to a source that is already taken as often as allowed.
    most = F.lit(int(MAX_EPOCHS)).cast("long")
    return out.withColumn("__llm_copies", F.least(F.col("__llm_whole") + extra, most)).drop("__llm_src", "__llm_whole", "__llm_cut", "__llm_salt", "__llm_part")


def repeat(docs: DataFrame, **names: str) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` as often as the mix takes it."""
    mixed = copies(docs, **names).where(F.col("__llm_copies") > 0)
    return mixed.withColumn("__llm_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__llm_copies")))).select(*[f"`{c}`" for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return copies(docs.select("doc_id", "text", "source")).select(
        "doc_id",
        F.col("__llm_size").alias("size"),
        F.col("__llm_source_size").alias("source_size"),
        F.col("__llm_target").alias("target"),
        (F.col("__llm_size") * F.col("__llm_copies")).cast("long").alias("taken"),
    )


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    md5('{SEED}:' || doc_id::VARCHAR) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 3 AS cap FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s),
r AS (SELECT 0 AS i, (SELECT sum(source_size) FROM w)::DOUBLE / (SELECT sum(w) FROM w) AS lv
  UNION ALL SELECT i + 1, (SELECT (sum(source_size)::DOUBLE - sum(CASE WHEN cap <= w * lv THEN cap ELSE 0 END))
    / sum(CASE WHEN cap <= w * lv THEN 0 ELSE w END) FROM w) FROM r WHERE i < 40),
t AS (SELECT source, source_size, least(cap, w * (SELECT max(lv) FROM r)) AS target FROM w),
c AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY d.source ORDER BY o) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN upto - size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""
