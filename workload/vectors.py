"""Hill numbers over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from effnum.operators import hill, vectors

from .registry import SQL, query, rounded, table

# The definition: every pair of a group, the diagonal at one.
PAIRS = """
    WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    u AS (SELECT label, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM v),
    s AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j,
        list_inner_product(a.e, b.e) / (a.len * b.len) AS c,
        list_sum(list_transform(list_zip(a.e, b.e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS l2,
        list_sum(list_transform(list_zip(a.e, b.e), lambda t: abs(t[1] - t[2]))) AS l1,
        list_max(list_transform(list_zip(a.e, b.e), lambda t: abs(t[1] - t[2]))) AS linf
      FROM u a JOIN u b USING (label))"""


def _hill_sql(sim: str) -> str:
    return f"""{PAIRS},
    zp AS (SELECT label, i, avg(CASE WHEN i = j THEN 1.0 ELSE {sim} END) AS z FROM s GROUP BY ALL)
    SELECT label, 'document_semantics' AS metric,
      round(CASE WHEN min(z) <= -1e-10 THEN count(*) ELSE exp(-avg(ln(
        CASE WHEN z > -1e-10 THEN z + 1e-10 ELSE 1 END))) END, 6) AS diversity,
      count(*) AS n_species,
      CASE WHEN min(z) <= -1e-10 THEN 'undefined' WHEN min(z) < 0 THEN 'negative_zp' ELSE 'ok' END AS status,
      false AS saturated
    FROM zp GROUP BY label"""


def _embeddings(spark, folder):
    return table(spark, folder, "embeddings")


def _hill(spark, folder, **similarity):
    out = vectors.document_diversity(
        _embeddings(spark, folder), ["label"], "vec_id", "embedding", dim=64, **similarity
    )
    return rounded(out, "diversity")


@query("hill_cosine_by_label", _hill_sql("c"))
def hill_cosine(spark, folder):
    """Half the cosines are negative: exercises the fallback to the species count."""
    return _hill(spark, folder)


@query("hill_squared_cosine_by_label", _hill_sql("c * c"))
def hill_squared_cosine(spark, folder):
    return _hill(spark, folder, power=True)


@query("hill_inverted_cosine_by_label", _hill_sql("1 - c"))
def hill_inverted(spark, folder):
    return _hill(spark, folder, postprocess="invert")


@query("hill_inverted_squared_by_label", _hill_sql("(1 - c) * (1 - c)"))
def hill_inverted_squared(spark, folder):
    return _hill(spark, folder, postprocess="invert", power=True)


@query("hill_exp_l2_by_label", _hill_sql("exp(-l2)"))
def hill_exp_l2(spark, folder):
    return _hill(spark, folder, metric="l2sq", postprocess="exp")


@query("hill_l2_by_label", _hill_sql("l2"))
def hill_l2(spark, folder):
    return _hill(spark, folder, metric="l2sq")


@query("hill_exp_l1_by_label", _hill_sql("exp(-l1)"))
def hill_exp_l1(spark, folder):
    return _hill(spark, folder, metric="l1", postprocess="exp")


@query("hill_exp_linf_by_label", _hill_sql("exp(-linf)"))
def hill_exp_linf(spark, folder):
    return _hill(spark, folder, metric="linf", postprocess="exp")


@query(
    "hill_mean_adjusted_by_label",
    f"""{PAIRS},
    mu AS (SELECT label, avg(c * c) AS m FROM s WHERE i <> j GROUP BY label),
    zp AS (SELECT label, i, avg(CASE WHEN i = j THEN 1.0 ELSE greatest(c * c - m, 0) END) AS z
      FROM s JOIN mu USING (label) GROUP BY ALL)
    SELECT label, 'document_semantics' AS metric, round(exp(-avg(ln(z + 1e-10))), 6) AS diversity,
      count(*) AS n_species, 'ok' AS status, false AS saturated FROM zp GROUP BY label""",
)
def hill_mean_adjusted(spark, folder):
    return _hill(spark, folder, power=True, mean_adjust=True)


@query(
    "hill_profile_by_label",
    f"""{PAIRS},
    zp AS (SELECT label, i, avg(CASE WHEN i = j THEN 1.0 ELSE c * c END) AS z FROM s GROUP BY ALL),
    d AS (SELECT label, count(*) AS n, avg(1 / z) AS q0, exp(-avg(ln(z + 1e-10))) AS q1,
        1 / avg(z) AS q2, avg(z * z) ** -0.5 AS q3, 1 / max(z) AS qinf FROM zp GROUP BY label)
    SELECT label, q, round(d, 6) AS diversity, n AS n_species FROM (
      SELECT label, n, 0.0::DOUBLE AS q, q0 AS d FROM d UNION ALL SELECT label, n, 1.0, q1 FROM d
      UNION ALL SELECT label, n, 2.0, q2 FROM d UNION ALL SELECT label, n, 3.0, q3 FROM d
      UNION ALL SELECT label, n, -1.0, qinf FROM d)""",
)
def hill_profile(spark, folder):
    mass = vectors.similarity_mass(
        _embeddings(spark, folder), ["label"], "vec_id", "embedding", power=True, dim=64
    )
    out = hill.profile(mass, ["label"], [0.0, 1.0, 2.0, 3.0, float("inf")])
    # Infinity is shown as -1, which every engine compares alike.
    q = F.when(F.col("q") > 1e9, F.lit(-1.0)).otherwise(F.col("q"))
    return rounded(out.select("label", q.alias("q"), "diversity", "n_species"), "diversity")


@query(
    "hill_normalized_by_label",
    f"""{PAIRS},
    zp AS (SELECT label, i, avg(CASE WHEN i = j THEN 1.0 ELSE c * c END) AS z FROM s GROUP BY ALL)
    SELECT label, round(exp(-avg(ln(z + 1e-10))) / count(*), 6) AS diversity FROM zp GROUP BY label""",
)
def hill_normalized(spark, folder):
    return _hill(spark, folder, power=True, normalize=True).select("label", "diversity")


@query(
    "hill_weighted_by_label",
    f"""{PAIRS},
    w AS (SELECT label, vec_id, (1 + vec_id % 3)::DOUBLE AS w FROM embeddings),
    p AS (SELECT label, vec_id, w / sum(w) OVER (PARTITION BY label) AS p FROM w),
    zp AS (SELECT s.label, i, sum(p.p * CASE WHEN i = j THEN 1.0 ELSE c * c END) AS z
      FROM s JOIN p ON p.label = s.label AND p.vec_id = s.j GROUP BY ALL)
    SELECT zp.label, round(exp(-sum(p.p * ln(z + 1e-10))), 6) AS diversity
    FROM zp JOIN p ON p.label = zp.label AND p.vec_id = zp.i GROUP BY zp.label""",
)
def hill_weighted(spark, folder):
    df = _embeddings(spark, folder).withColumn("w", F.lit(1) + F.col("vec_id") % 3)
    out = vectors.document_diversity(
        df, ["label"], "vec_id", "embedding", power=True, weight="w", dim=64
    )
    return rounded(out.select("label", "diversity"), "diversity")


@query(
    "hill_squared_cosine_whole_table",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM v),
    zp AS (SELECT a.vec_id, avg(CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE
        (list_inner_product(a.e, b.e) / (a.len * b.len)) ** 2 END) AS z FROM u a, u b GROUP BY 1)
    SELECT round(exp(-avg(ln(z + 1e-10))), 6) AS diversity, count(*) AS n_species FROM zp""",
)
def hill_whole_table(spark, folder):
    out = vectors.document_diversity(
        _embeddings(spark, folder), [], "vec_id", "embedding", power=True, dim=64
    )
    return rounded(out.select("diversity", "n_species"), "diversity")


@query(
    "mean_similarity_by_label",
    f"""{PAIRS}
    SELECT label, round(avg(CASE WHEN i = j THEN 1.0 ELSE c END), 6) AS similarity
    FROM s GROUP BY label""",
)
def mean_similarity(spark, folder):
    df = _embeddings(spark, folder)
    return rounded(vectors.mean_similarity(df, ["label"], "vec_id", "embedding"), "similarity")


@query(
    "mean_cosine_by_label",
    f"""{PAIRS}
    SELECT s.label, any_value(k.n) AS n, round(avg(c), 6) AS mean_cosine
    FROM s JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) k USING (label)
    WHERE i <> j GROUP BY s.label""",
)
def mean_cosine(spark, folder):
    return rounded(vectors.mean_cosine(_embeddings(spark, folder), ["label"], "embedding"), "mean_cosine")


@query(
    "similarity_pairs_by_label",
    f"{PAIRS} SELECT label, i, j, round(CASE WHEN i = j THEN 1.0 ELSE c END, 6) AS sim FROM s",
)
def similarity_pairs(spark, folder):
    return rounded(vectors.pairs(_embeddings(spark, folder), ["label"], "vec_id", "embedding"), "sim")


# Blocks of a few rows: the route of large groups, with balls and tiles, on any table.
def _in_blocks(spark, folder, df, **similarity):
    out = vectors.document_diversity(df, ["label"], "vec_id", "embedding", height=16, **similarity)
    return rounded(out, "diversity")


def _scaled(spark, folder):
    """Vectors thirty times as long, so that far ones have a similarity near zero."""
    return _embeddings(spark, folder).withColumn(
        "embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(30.0))
    )


# Everything is so far apart that nothing but the species themselves is left: saturated.
@query(
    "hill_exp_l1_in_balls_by_label",
    _hill_sql("exp(-30 * l1)").replace("false AS saturated", "count(*) > 1 AND max(z) - 1.0 / count(*) <= 1e-10 AS saturated"),
)
def hill_exp_l1_balls(spark, folder):
    return _in_blocks(spark, folder, _scaled(spark, folder), metric="l1", postprocess="exp")


@query("hill_exp_linf_in_balls_by_label", _hill_sql("exp(-30 * linf)"))
def hill_exp_linf_balls(spark, folder):
    return _in_blocks(spark, folder, _scaled(spark, folder), metric="linf", postprocess="exp")


@query("hill_exp_l2_in_balls_by_label", _hill_sql("exp(-l2)"))
def hill_exp_l2_balls(spark, folder):
    return _in_blocks(spark, folder, _embeddings(spark, folder), metric="l2sq", postprocess="exp")


@query("hill_mean_adjusted_in_balls_by_label", SQL["hill_mean_adjusted_by_label"])
def hill_mean_adjusted_balls(spark, folder):
    return _in_blocks(spark, folder, _embeddings(spark, folder), power=True, mean_adjust=True)


@query("hill_squared_cosine_in_blocks_by_label", SQL["hill_squared_cosine_by_label"])
def hill_squared_cosine_blocks(spark, folder):
    """Second moments of groups of several blocks."""
    return _in_blocks(spark, folder, _embeddings(spark, folder), power=True)


@query("hill_weighted_in_balls_by_label", SQL["hill_weighted_by_label"].replace("c * c", "exp(-l1)"))
def hill_weighted_balls(spark, folder):
    df = _embeddings(spark, folder).withColumn("w", F.lit(1) + F.col("vec_id") % 3)
    out = _in_blocks(spark, folder, df, metric="l1", postprocess="exp", weight="w")
    return out.select("label", "diversity")
