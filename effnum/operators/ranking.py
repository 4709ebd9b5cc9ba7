"""Ranking documents by similarity to queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import partitions
from .ordinals import head, ordinal
from .vectors import pair_score

TASK_PAIRS = 1 << 18  # pairs a task scores
MOST_TASKS = 64  # tasks per shuffle partition


def against_queries(
    queries: DataFrame, corpus: DataFrame, feature: str, query_id: str = "query_id", id: str = "doc_id"
) -> DataFrame:
    """``query_id, id, _q, _c``: every query beside every document.

    Scoring all documents for all queries is the task itself. It is an equi-join on
    a bucket of the corpus, with the queries offered to every bucket: the corpus is
    never copied, and the queries are joined bucket by bucket. The number of tasks
    follows the number of pairs, from the session's shuffle partitions upwards, so a
    task stays short when the corpus grows.
    """
    least = partitions(corpus)
    tasks = min(max(least, -(-queries.count() * corpus.count() // TASK_PAIRS)), MOST_TASKS * least)
    buckets = 4 * tasks  # several a task, so that tasks are about equal
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(feature).alias("_q"), every.alias("_slot"))
    slot = F.pmod(F.xxhash64(id), F.lit(buckets)).cast("int")
    c = corpus.select(F.col(id).alias("id"), F.col(feature).alias("_c"), slot.alias("_slot"))
    # Explicit numbers: the work of a pair is far larger than its bytes, by which Spark would merge tasks.
    return c.repartition(tasks, "_slot").join(q.repartition(tasks, "_slot").hint("merge"), "_slot").drop("_slot")


def top_k(scored: DataFrame, k: int = 1) -> DataFrame:
    """``query_id, rank, id, score``: the best ``k`` documents per query, all with -1.

    Ties go to the smaller id. The ranking is done per bucket of documents first, so
    that no task sees more than ``k`` rows per bucket of one query.
    """
    best = [F.desc("score"), F.asc("id")]
    if k < 0:
        ranked = ordinal(scored, ["query_id"], best, "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
        return ranked.select("query_id", "rank", "id", "score")
    return head(scored, ["query_id"], best, k, "id").select("query_id", "rank", "id", "score")


def rank_similarity(
    queries: DataFrame,
    corpus: DataFrame,
    on: str = "vec",
    k: int = 1,
    query_id: str = "query_id",
    id: str = "doc_id",
    metric: str = "cosine",
    postprocess: str | None = None,
) -> DataFrame:
    """Rank corpus rows by vector similarity to each query: ``query_id, rank, id, score``."""
    pairs = against_queries(queries, corpus, on, query_id, id)
    q, c = F.col("_q").cast("array<double>"), F.col("_c").cast("array<double>")
    score = pair_score(q, c, metric, postprocess, False)
    return top_k(pairs.select("query_id", "id", score.alias("score")), k)
