"""Estimation, ranking, selection, evaluation, corpus construction, windows of time."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from effnum.functions import text as tx
from effnum.operators import (
    corpora,
    custom,
    encode,
    estimate,
    evaluate,
    ranking,
    reduce,
    selection,
    sequences,
    tokens,
    vectors,
)
from effnum.plans import metrics
from effnum.session import cut_lineage
from effnum.streaming import windows

from .lexical import TOKENS
from .registry import query, r6, rounded, table

# ---- token semantics -------------------------------------------------------


def word_vectors(spark, folder):
    """Words of the conversations with a vector of a few letter counts."""
    turns = table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("doc_id"), "text")
    words = encode.token_table(turns, ["conv_id"])
    counts = [F.regexp_count("token", F.lit(f"[{c}]")).cast("double") for c in ("aeiou", "tnrs", "lmdc")]
    return words.withColumn("vec", F.array(*counts, F.lit(1.0)))


TOKEN_PAIRS = f"""
    WITH t AS (SELECT conv_id, turn, {TOKENS} AS t FROM conversations),
    w AS (SELECT conv_id, unnest(t) AS x FROM t),
    v AS (SELECT conv_id, x, [len(regexp_extract_all(x, '[aeiou]')), len(regexp_extract_all(x, '[tnrs]')),
        len(regexp_extract_all(x, '[lmdc]')), 1]::DOUBLE[] AS e FROM w),
    f AS (SELECT conv_id, e, count(*)::DOUBLE AS c FROM v GROUP BY ALL),
    n AS (SELECT conv_id, sum(c) AS n FROM f GROUP BY conv_id),
    p AS (SELECT a.conv_id, a.e, a.c AS ca, b.e = a.e AS same, b.c AS cb, list_cosine_similarity(a.e, b.e) ** 2 AS s
      FROM f a JOIN f b USING (conv_id))"""


@query(
    "token_hill_by_conversation",
    f"""{TOKEN_PAIRS},
    z AS (SELECT conv_id, e, any_value(ca) AS c, any_value(n) AS n, sum(cb * s) / any_value(n) AS z
      FROM p JOIN n USING (conv_id) GROUP BY conv_id, e)
    SELECT conv_id, round(exp(-sum(c / n * ln(z + 1e-10))), 6) AS diversity, any_value(n)::BIGINT AS n_species
    FROM z GROUP BY conv_id""",
)
def token_hill(spark, folder):
    out = tokens.token_diversity(word_vectors(spark, folder), ["conv_id"], mean_adjust=False, dim=4)
    return rounded(out.select("conv_id", "diversity", "n_species"), "diversity")


@query(
    "token_hill_adjusted_by_conversation",
    f"""{TOKEN_PAIRS},
    mu AS (SELECT conv_id, (sum(ca * cb * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1)) AS m
      FROM p JOIN n USING (conv_id) GROUP BY conv_id),
    z AS (SELECT conv_id, e, any_value(ca) AS c, any_value(n) AS n,
        (1 + sum((cb - CASE WHEN same THEN 1 ELSE 0 END) * greatest(s - m, 0))) / any_value(n) AS z
      FROM p JOIN n USING (conv_id) JOIN mu USING (conv_id) GROUP BY conv_id, e)
    SELECT conv_id, round(exp(-sum(c / n * ln(z + 1e-10))), 6) AS diversity, any_value(n)::BIGINT AS n_species
    FROM z GROUP BY conv_id""",
)
def token_hill_adjusted(spark, folder):
    out = tokens.token_diversity(word_vectors(spark, folder), ["conv_id"], dim=4)
    return rounded(out.select("conv_id", "diversity", "n_species"), "diversity")


@query("pca_hill_by_label")
def pca_hill(spark, folder):
    df = table(spark, folder, "embeddings")
    out = vectors.document_diversity(df, ["label"], "vec_id", "embedding", n_components="auto", power=True, dim=64)
    return rounded(out, "diversity")


@query(
    "pca_variance_by_label",
    """SELECT label, count(*) AS n, round(count(*) * ((var_pop(x) + var_pop(y)) / 2
        + sqrt(((var_pop(x) - var_pop(y)) / 2) ** 2 + covar_pop(x, y) ** 2)), 6) AS total
    FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) GROUP BY label""",
)
def pca_variance(spark, folder):
    """Squares on the first axis of two coordinates: the larger root of their 2 x 2 moments, which SQL can write down."""
    plane = F.slice(F.col("embedding").cast("array<double>"), 1, 2)
    df = table(spark, folder, "embeddings").withColumn("x", plane)
    first = F.get("pca", F.lit(0))
    reduced = reduce.pca(df, ["label"], "vec_id", "x", 1, dim=2).groupBy("label")
    return reduced.agg(F.count("*").alias("n"), F.sum(first * first).alias("t")).select("label", "n", r6(F.col("t")).alias("total"))


@query("pca_whole_variance_by_label")
def pca_whole_variance(spark, folder):
    """Squares on the first eight axes of whole vectors; compared with a brute-force eigendecomposition in the tests."""
    df = table(spark, folder, "embeddings")
    reduced = reduce.pca(df, ["label"], "vec_id", "embedding", 8, dim=64).groupBy("label")
    squares = F.aggregate("pca", F.lit(0.0), lambda s, v: s + v * v)
    return reduced.agg(F.count("*").alias("n"), F.sum(squares).alias("t")).select("label", "n", r6(F.col("t")).alias("total"))


def _gap(a, b):
    """Largest difference of two vectors, for every pair of rows."""
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out = np.maximum(out, np.abs(a[:, k][:, None] - b[:, k][None, :]))
    return out


@query(
    "custom_hill_by_label",
    """WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    zp AS (SELECT a.label, a.vec_id, avg(exp(-20 * list_max(list_transform(list_zip(a.e, b.e), lambda t: abs(t[1] - t[2]))))) AS z
      FROM v a JOIN v b USING (label) GROUP BY ALL)
    SELECT label, round(exp(-avg(ln(z + 1e-10))), 6) AS diversity, count(*) AS n_species FROM zp GROUP BY label""",
)
def custom_hill(spark, folder):
    """A user's similarity of whole vectors, with a bound by the boxes around blocks of neighbours."""
    df = table(spark, folder, "embeddings")
    df = df.withColumn("x", F.col("embedding").cast("array<double>")).withColumn("first", F.col("x")[0])

    def near(a, b):
        return np.exp(-20 * _gap(a, b))

    def box(rows):
        return np.min(rows, axis=0), np.max(rows, axis=0)

    def upper(a, b):
        return float(np.exp(-20 * np.maximum(np.maximum(a[0] - b[1], b[0] - a[1]), 0).max()))

    out = custom.hill_custom(df, ["label"], "vec_id", "x", near, height=32, near="first", summary=box, upper=upper)
    return rounded(out.select("label", "diversity", "n_species"), "diversity")


# ---- estimation ------------------------------------------------------------

SIZES = [50, 100, 200]


@query(
    "nested_sample_ttr_by_lang",
    f"""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING count(*) > 200),
    r AS (SELECT lang, trial, doc_id, row_number() OVER (PARTITION BY lang, trial
        ORDER BY md5((42 + trial)::VARCHAR || ':' || doc_id::VARCHAR), doc_id) AS rk
      FROM documents JOIN n USING (lang), (SELECT unnest([0, 1]) AS trial)),
    s AS (SELECT lang, trial, size, doc_id FROM r, (SELECT unnest({SIZES}) AS size) WHERE rk <= size),
    w AS (SELECT s.lang, trial, size, unnest({TOKENS}) AS g FROM s JOIN documents d ON d.doc_id = s.doc_id),
    t AS (SELECT lang, trial, size, count(DISTINCT g) / count(*) AS v FROM w GROUP BY ALL)
    SELECT lang, size, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM t GROUP BY ALL""",
)
def nested_sample_ttr(spark, folder):
    docs = table(spark, folder, "documents").select("lang", "doc_id", "text")
    out = estimate.estimate_diversity(docs, ["lang"], metrics.type_token_ratio())
    points = F.explode(F.arrays_zip("sample_sizes", "means", "stds")).alias("p")
    rows = out.where(F.col("method") == "extrapolation").select("lang", points)
    return rows.select(
        "lang", F.col("p.sample_sizes").alias("size"), r6("p.means").alias("mean"), r6("p.stds").alias("std")
    )


@query("estimate_semantic_by_lang")
def estimate_semantic(spark, folder):
    docs = table(spark, folder, "documents").select("lang", "doc_id", "text")
    return rounded(estimate.estimate_diversity(docs, ["lang"], metrics.document_semantics(power=True)), "diversity")


@query("estimate_whole_corpus")
def estimate_whole_corpus(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return rounded(estimate.estimate_diversity(docs, [], metrics.distinct_n(2)), "diversity")


@query("growth_fit_by_event_type")
def growth_fit(spark, folder):
    """Distinct users seen after each day, fitted per event type."""
    events = table(spark, folder, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    days = events.groupBy("event_type").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    firsts = events.groupBy("event_type", "user_id").agg(F.min("day").alias("seen"))
    # A user counts on every day from the first sighting to the last day of the type.
    sizes = firsts.join(days, "event_type").withColumns(
        {"d": F.datediff("seen", "first"), "end": F.datediff("last", "first")}
    )
    points = sizes.select("event_type", F.explode(F.sequence(F.col("d"), F.col("end"))).alias("size"))
    curve = points.groupBy("event_type", (F.col("size") + 1).alias("size")).agg((F.count("*") / 100.0).alias("mean"))
    return rounded(estimate.fit_growth(curve, ["event_type"]), "a", "b", "c", "rmse")


# ---- ranking ---------------------------------------------------------------


def centroids(spark, folder):
    df = table(spark, folder, "embeddings")
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))))
    return df.groupBy(F.col("label").alias("query_id")).agg(mean.alias("embedding"))


CENTROIDS = """
    WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    q AS (SELECT label AS query_id, list(a ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS a FROM (
        SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY ALL) GROUP BY label),
    s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(c, e) AS score FROM q, v)"""


@query(
    "rank_top5_by_centroid",
    f"""{CENTROIDS}, r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank,
        id, score FROM s)
    SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def rank_top5(spark, folder):
    out = ranking.rank_similarity(
        centroids(spark, folder), table(spark, folder, "embeddings"), "embedding", 5, id="vec_id"
    )
    return rounded(out, "score")


@query(
    "rank_all_by_centroid",
    f"""{CENTROIDS} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank,
      id, round(score, 6) AS score FROM s""",
)
def rank_all(spark, folder):
    out = ranking.rank_similarity(
        centroids(spark, folder), table(spark, folder, "embeddings"), "embedding", -1, id="vec_id"
    )
    return rounded(out, "score")


@query("rank_sequences_by_benchmark")
def rank_sequences(spark, folder):
    """Conversation turns by the likeness of their word shapes to benchmark items."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), tx.shape_tags("text").alias("tags"))
    turns = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), tx.shape_tags("text").alias("tags")
    )
    return rounded(sequences.rank_sequences(items, turns, "tags", 3), "score")


# ---- selection -------------------------------------------------------------


def plain_profiles(spark, folder):
    """Documents as small vectors of text statistics."""
    docs = table(spark, folder, "documents")
    return docs.select(
        "lang",
        F.col("doc_id").alias("id"),
        F.array(
            F.log1p(F.col("n_chars").cast("double")),
            tx.shape_variety("text"),
            tx.vowel_variety("text"),
            tx.unique_word_ratio("text"),
            tx.length_proxy("text"),
        ).alias("vec"),
    )


def _register_selection(method: str) -> None:
    @query(f"select_{method}_by_lang")
    def by_lang(spark, folder):
        return rounded(selection.select_diverse(plain_profiles(spark, folder), 5, method, by=["lang"]), "score")


for _method in selection.METHODS:
    _register_selection(_method)


@query(
    "select_max_min_by_label",
    """WITH RECURSIVE v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, md5('42:' || vec_id) AS t FROM embeddings),
    s AS (
      SELECT 1 AS rank, label, arg_min(vec_id, t) AS id, [arg_min(e, t)] AS chosen, [arg_min(vec_id, t)] AS ids
      FROM v GROUP BY label
      UNION ALL
      SELECT rank + 1, label, x.vec_id, list_append(chosen, x.e), list_append(ids, x.vec_id) FROM (
        SELECT s.rank, s.label, s.chosen, s.ids, v.vec_id, v.e, row_number() OVER (PARTITION BY s.label ORDER BY
          list_max(list_transform(s.chosen, lambda c: list_cosine_similarity(c, v.e))), v.vec_id) AS rn
        FROM s JOIN v ON v.label = s.label AND NOT list_contains(s.ids, v.vec_id) WHERE s.rank < 4) x WHERE rn = 1)
    SELECT label, rank::INTEGER AS rank, id AS vec_id FROM s""",
)
def select_max_min_by_label(spark, folder):
    df = table(spark, folder, "embeddings")
    out = selection.max_min(df, 4, id="vec_id", vec="embedding", by=["label"])
    return out.select("label", "rank", "vec_id")


@query(
    "first_facility_by_label",
    """WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    g AS (SELECT a.label, a.vec_id, sum(list_cosine_similarity(a.e, b.e)) AS gain FROM v a JOIN v b USING (label) GROUP BY ALL)
    SELECT label, arg_max(vec_id, gain) AS vec_id FROM g GROUP BY label""",
)
def first_facility(spark, folder):
    df = table(spark, folder, "embeddings")
    return selection.facility_location(df, 1, id="vec_id", vec="embedding", by=["label"]).select("label", "vec_id")


@query("selection_summary_by_lang")
def selection_summary(spark, folder):
    rows = cut_lineage(plain_profiles(spark, folder))  # read by every selection and every summary
    parts = [
        selection.summary(rows, selection.select_diverse(rows, 5, m, by=["lang"]), m, by=["lang"])
        for m in selection.METHODS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- evaluation ------------------------------------------------------------

LABELLED = "SELECT d.lang, d.source, d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)"


def labelled(spark, folder):
    docs = table(spark, folder, "documents").select("lang", "source", "doc_id", "n_chars")
    return docs.join(table(spark, folder, "labels"), "doc_id")


@query(
    "spearman_quality_by_lang",
    f"""WITH d AS ({LABELLED}),
    r AS (SELECT lang,
        rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS ry
      FROM d)
    SELECT lang, count(*) AS n, round(CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END, 6) AS rho FROM r GROUP BY lang""",
)
def spearman_quality(spark, folder):
    return rounded(evaluate.spearman(labelled(spark, folder), ["lang"], "quality", "n_chars"), "rho")


@query(
    "pearson_quality_by_lang",
    f"WITH d AS ({LABELLED}) SELECT lang, count(*) AS n, round(CASE WHEN stddev_pop(quality) > 0 AND stddev_pop(n_chars) > 0 THEN corr(quality, n_chars) END, 6) AS r FROM d GROUP BY lang",
)
def pearson_quality(spark, folder):
    return rounded(evaluate.pearson(labelled(spark, folder), ["lang"], "quality", "n_chars"), "r")


@query(
    "ordinal_correlation_by_lang",
    f"""WITH d AS ({LABELLED}),
    r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY quality, doc_id) AS a,
        row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS b FROM d)
    SELECT lang, count(*) AS n, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 6) AS r FROM r GROUP BY lang""",
)
def ordinal_correlation(spark, folder):
    out = evaluate.ordinal_correlation(labelled(spark, folder), ["lang"], "doc_id", "quality", "n_chars")
    return rounded(out, "r")


@query(
    "pair_accuracy_by_lang",
    f"""WITH d AS ({LABELLED}),
    s AS (SELECT lang, source, avg(n_chars) FILTER (quality = 1) AS hi, avg(n_chars) FILTER (quality = 0) AS lo
      FROM d GROUP BY ALL)
    SELECT lang, count(*) AS n_pairs, round(avg((hi > lo)::INTEGER), 6) AS accuracy FROM s
    WHERE hi IS NOT NULL AND lo IS NOT NULL GROUP BY lang""",
)
def pair_accuracy(spark, folder):
    out = evaluate.pair_accuracy(labelled(spark, folder), "source", "quality", "n_chars", ["lang"])
    return rounded(out, "accuracy")


@query(
    "pair_limit",
    f"""WITH d AS ({LABELLED}) SELECT source, count(*) AS n FROM d
    WHERE source IN (SELECT DISTINCT source FROM d ORDER BY source LIMIT 7) GROUP BY source""",
)
def pair_limit(spark, folder):
    kept = evaluate.limit_pairs(labelled(spark, folder), "source", 7)
    return kept.groupBy("source").agg(F.count("*").alias("n"))


@query(
    "calibration_by_lang_and_quality",
    f"""WITH d AS ({LABELLED})
    SELECT coalesce(lang, 'all') AS lang, coalesce(quality, -1) AS quality, count(*) AS n,
      round(avg(n_chars / (1000 + doc_id % 7)), 6) AS ratio, round(avg(abs(n_chars - (1000 + doc_id % 7))), 6) AS mae
    FROM d GROUP BY GROUPING SETS ((lang, quality), ())""",
)
def calibration(spark, folder):
    rows = labelled(spark, folder).withColumn("truth", F.lit(1000) + F.col("doc_id") % 7)
    out = evaluate.calibration(rows, ["lang", "quality"], "n_chars", "truth")
    named = out.withColumn("lang", F.coalesce("lang", F.lit("all"))).withColumn(
        "quality", F.coalesce("quality", F.lit(-1))
    )
    return rounded(named, "ratio", "mae")


@query(
    "median_ratio_by_lang",
    f"""WITH d AS ({LABELLED}) SELECT lang, count(*) AS n, round(median(n_chars / (doc_id % 7)), 6) AS median_ratio
    FROM d WHERE doc_id % 7 > 0 GROUP BY lang""",
)
def median_ratio(spark, folder):
    rows = labelled(spark, folder).withColumn("truth", F.col("doc_id") % 7)
    return rounded(evaluate.median_ratio(rows, ["lang"], "n_chars", "truth"), "median_ratio")


def source_scores(spark, folder):
    docs = table(spark, folder, "documents").select("source", "doc_id", "text")
    chosen = {"type_token_ratio": metrics.type_token_ratio(), "distinct_2": metrics.distinct_n(2)}
    return evaluate.score_grid(docs, "source", chosen).withColumnRenamed("source", "corpus")


GRID = rf"""
    WITH t AS (SELECT source, doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t FROM documents),
    g1 AS (SELECT source, unnest(t) AS g FROM t),
    g2 AS (SELECT source, unnest(CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)),
        lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END) AS g FROM t),
    scores AS (SELECT source AS corpus, 'type_token_ratio' AS metric, count(DISTINCT g) / count(*) AS score FROM g1 GROUP BY source
      UNION ALL SELECT source, 'distinct_2', count(DISTINCT g) / count(*) FROM g2 GROUP BY source)"""


@query("score_grid_by_source", f"{GRID} SELECT corpus, metric, round(score, 6) AS score FROM scores")
def score_grid(spark, folder):
    return rounded(source_scores(spark, folder), "score")


def source_contrasts(spark, folder):
    """Each source against the next one of about the same number of documents."""
    sizes = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"))
    after = F.lead("source").over(Window.partitionBy(F.floor(F.col("n") / 100)).orderBy("source"))
    pairs = sizes.select(F.col("source").alias("lesser"), after.alias("greater")).where(F.col("greater").isNotNull())
    even = F.length("greater") % 2 == 0
    return pairs.select(
        F.lit("semantic").alias("level"), F.when(even, "inverse_pair").otherwise("ceiling").alias("kind"), "greater", "lesser"
    )


CONTRASTS = f"""{GRID},
    n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    c AS (SELECT * FROM (SELECT source AS lesser, lead(source) OVER (PARTITION BY n // 100 ORDER BY source) AS greater FROM n)
      WHERE greater IS NOT NULL),
    j AS (SELECT h.metric, CASE WHEN length(greater) % 2 = 0 THEN 'inverse_pair' ELSE 'ceiling' END AS kind,
        (h.score > l.score)::INTEGER AS ok FROM c
      JOIN scores h ON h.corpus = greater JOIN scores l ON l.corpus = lesser AND l.metric = h.metric)"""


@query(
    "contrast_accuracy_by_metric",
    f"""{CONTRASTS} SELECT metric, 'semantic' AS level, kind, count(*) AS n, round(avg(ok), 6) AS accuracy
    FROM j GROUP BY metric, kind""",
)
def contrast_accuracy(spark, folder):
    out = evaluate.contrast_accuracy(source_contrasts(spark, folder), source_scores(spark, folder))
    return rounded(out, "accuracy")


@query(
    "inverse_pair_rate_by_metric",
    f"""{CONTRASTS} SELECT metric, count(*) AS n_pairs, round(avg(ok), 6) AS rate FROM j
    WHERE kind = 'inverse_pair' GROUP BY metric""",
)
def inverse_pair_rate(spark, folder):
    out = evaluate.inverse_pair_rate(source_contrasts(spark, folder), source_scores(spark, folder))
    return rounded(out, "rate")


@query(
    "within_corpus_by_source",
    f"""{GRID} SELECT a.corpus, 'syntactic' AS greater_level, 'morphological' AS lesser_level,
      round(a.score, 6) AS greater, round(b.score, 6) AS lesser, a.score > b.score AS satisfied
    FROM scores a JOIN scores b ON a.corpus = b.corpus AND a.metric = 'distinct_2' AND b.metric = 'type_token_ratio'""",
)
def within_corpus(spark, folder):
    checks = table(spark, folder, "documents").select(
        F.col("source").alias("corpus"), F.lit("syntactic").alias("greater_level"), F.lit("morphological").alias("lesser_level")
    ).distinct()
    levels = {"syntactic": "distinct_2", "morphological": "type_token_ratio"}
    return rounded(evaluate.within_corpus(checks, source_scores(spark, folder), levels), "greater", "lesser")


@query(
    "scaled_comparison_by_lang",
    """WITH s AS (SELECT lang, count(*)::DOUBLE AS n, avg(n_chars) AS len FROM documents GROUP BY lang)
    SELECT lang, round(n / max(n) OVER (), 6) AS n, round(len / max(len) OVER (), 6) AS len FROM s""",
)
def scaled_comparison(spark, folder):
    st = table(spark, folder, "documents").groupBy("lang").agg(
        F.count("*").cast("double").alias("n"), F.avg("n_chars").alias("len")
    )
    return rounded(evaluate.max_scaled(st, ["n", "len"]), "n", "len")


@query(
    "leaderboard_by_lang",
    f"WITH d AS ({LABELLED}) SELECT lang, round(avg(n_chars), 6) AS score FROM d GROUP BY lang ORDER BY score DESC",
)
def leaderboard(spark, folder):
    st = labelled(spark, folder).groupBy("lang").agg(F.avg("n_chars").alias("score"))
    return evaluate.leaderboard(rounded(st, "score"), "score")


# ---- corpora ---------------------------------------------------------------


def clusters(spark, folder):
    """Documents as concepts of their source, their sentences as paraphrases."""
    docs = table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("domain"), tx.sentences("text").alias("paraphrases"))


@query("synonymy_corpora")
def synonymy_corpora(spark, folder):
    return corpora.synonymy_corpora(clusters(spark, folder))


@query(
    "polysemy_corpora",
    """SELECT 'polysemy-' || conv_id AS id, 'polysemy' AS axis, count(*)::INTEGER AS n_documents,
      count(*)::DOUBLE AS true_diversity, md5(string_agg(text, '|' ORDER BY turn)) AS documents
    FROM conversations GROUP BY conv_id""",
)
def polysemy_corpora(spark, folder):
    turns = table(spark, folder, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    sets = turns.groupBy(F.col("conv_id").alias("id")).agg(
        F.min("role").alias("surface_form"), ordered["text"].alias("senses")
    )
    out = corpora.polysemy_corpora(sets)
    return out.select("id", "axis", "n_documents", "true_diversity", F.md5(F.array_join("documents", "|")).alias("documents"))


def families(spark, folder):
    """Records of every construction family, from conversations and documents."""
    turns = table(spark, folder, "conversations")
    sets = turns.groupBy(F.col("conv_id").cast("string").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "text")))["text"].alias("texts")
    )
    frames = clusters(spark, folder).select(F.col("id").cast("string").alias("id"), F.col("paraphrases").alias("texts"))
    pool = turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    parts = [
        corpora.subsampled_sets(sets, "syntactic_alternations", "alt"),
        corpora.grid_sets(frames, "syntactic_frames", "frame"),
        corpora.whole_sets(sets, "morphological_templates", "morph"),
        corpora.whole_sets(sets, "pos_identical_structure_different", "posid"),
        corpora.whole_sets(sets, "surface_parse_blind", "blind"),
        corpora.grid_sets(frames, "rhythmic_meters", "meter"),
        corpora.whole_sets(sets, "phonemic_oronyms", "oronym"),
        corpora.whole_sets(sets, "phonemic_minimal_pairs", "phon"),
        corpora.random_controls(pool),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "construction_corpora",
    """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
    grid AS (SELECT k, m FROM (SELECT unnest([1, 2, 3, 4]) AS k), (SELECT unnest([2, 3]) AS m)),
    alt AS (SELECT 'syntactic_alternations' AS family, unnest(range(2, n + 1)) AS n FROM c),
    fam AS (
      SELECT family, n, 1.0 AS semantic, n::DOUBLE AS syntactic, 1 AS times FROM alt
      UNION ALL SELECT 'syntactic_frames', k * m, k * m, k, 3 FROM grid
      UNION ALL SELECT 'rhythmic_meters', k * m, k * m, NULL, 3 FROM grid
      UNION ALL SELECT 'morphological_templates', n, 1, n, 1 FROM c
      UNION ALL SELECT 'pos_identical_structure_different', n, n, n, 1 FROM c
      UNION ALL SELECT 'surface_parse_blind', n, n, 1, 1 FROM c
      UNION ALL SELECT 'phonemic_oronyms', n, n, NULL, 1 FROM c
      UNION ALL SELECT 'phonemic_minimal_pairs', n, NULL, NULL, 1 FROM c
      UNION ALL SELECT DISTINCT 'random_controls', k * m, k * m, k * m, 3 FROM grid)
    SELECT family, n::INTEGER AS n_documents, sum(times)::BIGINT AS n_corpora, sum(semantic * times)::DOUBLE AS semantic,
      sum(syntactic * times)::DOUBLE AS syntactic FROM fam GROUP BY family, n""",
)
def construction_corpora(spark, folder):
    rows = families(spark, folder)
    return rows.groupBy("family", "n_documents").agg(
        F.count("*").alias("n_corpora"),
        F.sum(F.col("expected")["semantic"]).alias("semantic"),
        F.sum(F.col("expected")["syntactic"]).alias("syntactic"),
    )


@query("construction_contrasts")
def construction_contrasts(spark, folder):
    out = corpora.contrasts(families(spark, folder))
    return out.groupBy("level", "kind").agg(F.count("*").alias("n"))


@query("construction_score_grid")
def construction_score_grid(spark, folder):
    """The validation job end to end: build, score, judge."""
    from effnum.session import cut_lineage

    records = cut_lineage(families(spark, folder))
    corpus = corpora.as_corpus(records)
    chosen = {"type_token_ratio": metrics.type_token_ratio(), "self_bleu": metrics.self_bleu()}
    scores = cut_lineage(evaluate.score_grid(corpus, "corpus", chosen))
    return rounded(evaluate.contrast_accuracy(corpora.contrasts(records), scores), "accuracy")


# ---- windows of time -------------------------------------------------------


def event_vectors(spark, folder):
    events = table(spark, folder, "events")
    return events.withColumn(
        "vec", F.array(F.col("value"), (F.col("user_id") % 7).cast("double"), F.hour("ts").cast("double"))
    )


@query(
    "windowed_semantic_diversity",
    """WITH e AS (SELECT event_id, date_trunc('day', ts) AS d, [value, (user_id % 7)::DOUBLE, hour(ts)::DOUBLE] AS v FROM events),
    u AS (SELECT event_id, d, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM e),
    z AS (SELECT a.d, a.event_id, avg(CASE WHEN a.event_id = b.event_id THEN 1.0 WHEN a.l = 0 OR b.l = 0 THEN 0.0
        ELSE list_inner_product(a.v, b.v) / (a.l * b.l) END) AS z FROM u a JOIN u b USING (d) GROUP BY ALL)
    SELECT d::DATE::VARCHAR AS day, count(*) AS n_species, round(1 / avg(z), 6) AS diversity FROM z GROUP BY d""",
)
def windowed_semantic(spark, folder):
    out = windows.semantic_diversity(event_vectors(spark, folder), "ts", "vec", "1 day")
    return rounded(
        out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n_species", "diversity"), "diversity"
    )


@query(
    "windowed_squared_diversity",
    """WITH e AS (SELECT event_id, date_trunc('day', ts) AS d, [value, (user_id % 7)::DOUBLE, hour(ts)::DOUBLE] AS v FROM events),
    u AS (SELECT event_id, d, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM e),
    z AS (SELECT a.d, a.event_id, avg(CASE WHEN a.event_id = b.event_id THEN 1.0 WHEN a.l = 0 OR b.l = 0 THEN 0.0
        ELSE (list_inner_product(a.v, b.v) / (a.l * b.l)) ** 2 END) AS z FROM u a JOIN u b USING (d) GROUP BY ALL)
    SELECT d::DATE::VARCHAR AS day, count(*) AS n_species, round(1 / avg(z), 6) AS diversity FROM z GROUP BY d""",
)
def windowed_squared(spark, folder):
    out = windows.squared_diversity(event_vectors(spark, folder), "ts", "vec", "1 day", id="event_id")
    return rounded(
        out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n_species", "diversity"), "diversity"
    )


@query("windowed_type_token_ratio")
def windowed_ttr(spark, folder):
    events = table(spark, folder, "events").withColumn("text", F.concat_ws(" ", "event_type", "props"))
    out = windows.type_token_ratio(events, "ts", "text", "1 day", by=["event_type"])
    return rounded(
        out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n_total", "value"), "value"
    )
