"""Inputs that one task, or the driver, would hold whole."""

from pyspark.sql import functions as F

from effnum.operators import estimate, ranking
from effnum.plans import metrics
from workload import structures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_gathered_before_they_are_joined(spark, tmp_path):
    orders = [(1, "a"), (2, "b"), (2, "b"), (2, "c"), (3, None), (4, "a"), (None, "a")]
    lines = [(1, 2, "N"), (1, 1, "A"), (2, 1, "R"), (2, 2, None), (3, 1, "A"), (9, 1, "A"), (None, 1, "A"), (1, None, "R")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = structures.order_lines(spark, str(tmp_path), "l_returnflag")
    want = {("a", 1, ("R", "A", "N")), ("b", 2, ("R", "R", None, None)), ("c", 2, ("R", None)), (None, 3, ("A",))}
    rows = [(r[0], r[1], tuple(r.tags)) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
    # Files pack orders so well that Spark would broadcast millions of them.
    assert "BroadcastHashJoin" not in plan(found)


def test_a_whole_corpus_is_not_sent_to_its_one_key(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b"), "id").alias("text"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = estimate.estimate_diversity(docs, [], metrics.distinct_n(2))
        assert "SortMergeJoin" not in "".join(
            line for line in plan(found).splitlines() if "LeftSemi" in line
        )
        assert found.first().method == "extrapolation"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_scoring_tasks_follow_the_pairs(spark, monkeypatch):
    queries = spark.range(6).select(F.col("id").alias("query_id"), F.col("id").alias("v"))
    corpus = spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").alias("v"))
    monkeypatch.setattr(ranking, "TASK_PAIRS", 60, raising=False)
    pairs = ranking.against_queries(queries, corpus, "v")
    assert pairs.rdd.getNumPartitions() == 20
    assert pairs.distinct().count() == pairs.count() == 1200


def test_words_without_markers_are_not_gathered(spark):
    from effnum.operators import tokens

    rows = [("a", 1, k, w, [float(k)]) for k, w in enumerate(["x", "y", None, "x"])] + [("a", 2, 0, "z", [9.0])]
    marked = [("b", 1, 0, "un", [1.0]), ("b", 1, 1, "##do", [3.0]), ("b", 1, 2, "it", [5.0])]
    shape = "g string, doc_id int, pos int, token string, vec array<double>"
    want = {("a", 1, 0, "x", 0.0), ("a", 1, 1, "y", 1.0), ("a", 1, 2, "", 2.0), ("a", 1, 3, "x", 3.0), ("a", 2, 0, "z", 9.0)}
    both = tokens.merge_subwords(spark.createDataFrame(rows + marked, shape), ["g"])
    found = [(r.g, r.doc_id, r.word_no, r.word, r.vec[0]) for r in both.collect()]
    assert set(found) == want | {("b", 1, 0, "undo", 2.0), ("b", 1, 1, "it", 5.0)} and len(found) == 7
    alone = tokens.merge_subwords(spark.createDataFrame(rows, shape), ["g"])
    assert len(alone.collect()) == 5
    # The branch that gathers has none of these words.
    assert "Union" in plan(alone)
