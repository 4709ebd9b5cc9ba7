"""A corpus pipeline of five stages; each works on all rows that the one before kept.

Every stage is written as Parquet and read again, so a lost executor costs at most one
stage. Toxic documents go, repeated lines go, of each group of near duplicates the
document with the smallest id stays, sources are mixed to their target weights (a
document taken twice is two rows), and the last stage returns the ids' digests.

Defined cases: a null or empty text is an ordinary document for toxicity (scored by the
bias) and lines (nothing to drop), never a near duplicate, of size 0 in the mixing and
without tokens at the end; rows that are repeated or share an id are rows of their own
until the near duplicates, where one row of each group stays; rows without an id stay if
their group has no row with one; a null source is a source of its own; texts of any
length are read whole; if all usable labels agree, or there are none, nothing is known
about toxicity and all documents stay; an empty table gives an empty result; further
columns, whatever their names, are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from effnum.llm import bpe, line_dedup, mixing, near_duplicates, toxicity
from effnum.llm.common import read
from effnum.session import Scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the cut; trained on the labels of these documents."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    if not model[0].any():  # labels of one kind only tell nothing
        return docs
    scored = toxicity.score(docs, model, out="__llm_toxic")
    return scored.where(F.col("__llm_toxic") < toxicity.CUT).drop("__llm_toxic")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that a later document holds too; ``n_chars`` follows the text."""
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    changed = F.col("__llm_n_dropped") > 0
    values = {
        "text": F.when(changed, F.col("__llm_kept")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.length("__llm_kept").cast("long")).otherwise(F.col("n_chars")),
    }
    return cut.select(*[(values[c].alias(c) if c in values else F.col(c)) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return near_duplicates.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus; a document is a row as often as it is taken."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every remaining row."""
    return bpe.round_trip(docs, bpe.vocabulary())


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_duplicates", near), ("mixing", mix), ("bpe", encode)]

# A trained model and a tokenizer take part, which SQL can't express: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between is written below ``spark.checkpoint.dir``."""
    scratch = Scratch(spark)
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
