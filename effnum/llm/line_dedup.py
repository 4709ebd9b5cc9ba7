"""Line de-duplication over a whole corpus, in DataFrame operations only.

Lines become 128-bit hashes of their normalised form. Hashes are range-partitioned
together with the document id (descending) and sorted by hash, document and position,
so equal lines lie next to each other and a frequent line spreads over many ranges. The
first document in that order is the largest id that holds the line. Counts and first
documents are combined within each range before they are shuffled, hence a line held by
a third of all documents costs one row per range. What comes back per document is a
run-length coded keep bitmap, not text; ``apply_bitmaps`` cuts the texts.

Defined cases: a null or empty text is one empty line; a line whose key has fewer than
``min_chars`` code points always stays; a line repeated inside the document that keeps
it stays every time; rows with the same id count as one document, and a line position
is dropped for all rows of an id only if the key there is the row's own (rows are told
apart by their text); a null id is one more document, smaller than all others; further
columns of the input are ignored by ``keep_bitmaps`` and kept by ``apply_bitmaps``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import lower_ascii

BLANKS = " \t\n\x0b\x0c\r"
SALTS = 16  # parts in which the documents of one line meet its first document


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _keyed_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """One row per line that may be dropped: h1, h2, d, t (the text's hash), pos."""
    lines = docs.select(
        F.col(doc_id).alias("d"),
        F.xxhash64(text).alias("t"),
        F.posexplode(F.transform(lines_of(F.col(text)), line_key)).alias("pos", "key"),
    ).where(F.length("key") >= min_chars)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "d", "t", "pos")


def keep_bitmaps(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``d, t, n_dropped, dropped`` for each document that loses lines.

    ``dropped`` is the bitmap of lost lines in run-length form: an ordered array of
    (start, length), zero-based. Documents without a row keep everything.
    """
    lines = _keyed_lines(docs, doc_id, text, min_chars)
    ranged = lines.repartitionByRange("h1", "h2", F.col("d").desc()).sortWithinPartitions(
        "h1", "h2", F.col("d").desc(), "pos"
    )
    # A range holds each (hash, document) pair whole: no further shuffle for this step.
    held = cut_lineage(ranged.groupBy("h1", "h2", "d").agg(F.collect_list(F.struct("t", "pos")).alias("at")))
    firsts = (
        held.groupBy("h1", "h2").agg(F.max("d").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    )
    # A line of a third of all documents must not meet its first document in one task.
    salted = held.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)))
    spread = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    lost = (
        salted.join(spread, ["h1", "h2", "salt"])
        .where(~F.col("d").eqNullSafe(F.col("first")))
        .select("d", F.explode("at").alias("at"))
        .select("d", "at.t", "at.pos")
        .distinct()
    )
    run = F.col("pos") - F.row_number().over(Window.partitionBy("d", "t").orderBy("pos"))
    runs = lost.withColumn("run", run).groupBy("d", "t", "run").agg(
        F.min("pos").alias("start"), F.count("*").cast("int").alias("length")
    )
    return runs.groupBy("d", "t").agg(
        F.sum("length").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("start", "length"))).alias("dropped")
    )


def kept_runs(dropped: Column, n_lines: Column) -> Column:
    """The complement of the dropped runs: ordered (start, length) of the lines that stay."""
    end = lambda r: r["start"] + r["length"]
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(end(F.get(dropped, i - 1)))
    gaps = F.transform(dropped, lambda r, i: F.struct(before(i).alias("start"), (r["start"] - before(i)).alias("length")))
    last = F.coalesce(end(F.get(dropped, F.size(dropped) - 1)), F.lit(0))
    tail = F.struct(last.alias("start"), (n_lines - last).alias("length"))
    return F.filter(F.concat(gaps, F.array(tail)), lambda r: r["length"] > 0)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``__llm_n_lines``, ``__llm_n_dropped`` and ``__llm_kept`` (the text that stays)."""
    b = bitmaps.withColumnsRenamed({"d": "__llm_d", "t": "__llm_t", "n_dropped": "__llm_n_dropped", "dropped": "__llm_dropped"})
    joined = docs.withColumn("__llm_h", F.xxhash64(text)).join(
        b, F.col(doc_id).eqNullSafe(F.col("__llm_d")) & (F.col("__llm_h") == F.col("__llm_t")), "left"
    )
    lines = lines_of(F.col(text))
    parts = F.transform(kept_runs(F.col("__llm_dropped"), F.size(lines)), lambda r: F.slice(lines, r["start"] + 1, r["length"]))
    kept = F.when(F.col("__llm_dropped").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(
        F.array_join(F.flatten(parts), "\n")
    )
    return joined.withColumns(
        {"__llm_n_lines": F.size(lines), "__llm_n_dropped": F.coalesce("__llm_n_dropped", F.lit(0)), "__llm_kept": kept}
    ).drop("__llm_h", "__llm_d", "__llm_t", "__llm_dropped")


def digest(docs: DataFrame) -> DataFrame:
    cut = apply_bitmaps(docs, keep_bitmaps(docs))
    return cut.select(
        "doc_id",
        F.col("__llm_n_lines").cast("long").alias("n_lines"),
        F.col("__llm_n_dropped").cast("long").alias("n_dropped"),
        F.sha2("__llm_kept", 256).alias("kept_sha256"),
    )


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(len(ls))) AS pos FROM d),
l AS (SELECT doc_id, pos, ls[pos + 1] AS line,
    translate(trim(ls[pos + 1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM p),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.pos, l.line, k.key IS NOT NULL AND l.doc_id <> k.last AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
