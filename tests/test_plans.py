import math

import pytest
from pyspark.sql import functions as F

from effnum.plans import aggregate, config, metrics, profiles

SCORES = {
    "token_semantics": 8.0,
    "document_semantics": 2.0,
    "dependency_parse": 4.0,
    "pos_sequence": 2.0,
    "rhythmic": 2.0,
    "phonemic": 2.0,
}


def table(spark, scores, g="g"):
    return spark.createDataFrame([(g, m, float(s)) for m, s in scores.items()], "g string, metric string, score double")


def one(spark, scores, **settings):
    return aggregate.universal(table(spark, scores), ["g"], settings).first().universal


def test_strategies(spark):
    logs = 0.35 * math.log(4) + 0.30 * math.log(4) + 0.15 * math.log(2) + 0.20 * math.log(2)
    assert one(spark, SCORES) == pytest.approx(math.exp(logs))
    assert one(spark, SCORES, strategy="minimum") == 2.0
    assert one(spark, SCORES, strategy="harmonic") == pytest.approx(6 / (1 / 8 + 1 / 4 + 4 / 2))
    assert one(spark, {"token_semantics": 8, "rhythmic": 0}, strategy="harmonic") == 8.0
    assert one(spark, {"token_semantics": 0, "document_semantics": 4}) == pytest.approx(1e-10)
    geometric = one(spark, SCORES, strategy="weighted_geometric")
    arithmetic = one(spark, SCORES, strategy="weighted_arithmetic")
    assert one(spark, SCORES, strategy="harmonic") < geometric < arithmetic
    same = dict.fromkeys(SCORES, 3.0)
    for strategy in config.STRATEGIES:
        assert one(spark, same, strategy=strategy) == pytest.approx(3.0)
    with pytest.raises(ValueError):
        config.overlay({"strategy": "nope"})
    with pytest.raises(TypeError):
        config.overlay({"nope": 1})


def test_detailed_and_failures(spark):
    scores = {**SCORES, "phonemic": float("nan"), "unknown": 7.0, "constituency_parse": 9.0}
    row = aggregate.detailed(table(spark, scores), ["g"]).first()
    assert row.branches["semantic"] == pytest.approx(4.0) and row.branches["phonological"] == 0.0
    assert row.branches["syntactic"] == 4.0 and row.metrics["phonemic"] == 0.0 and "unknown" not in row.metrics
    bad = table(spark, SCORES).withColumn("status", F.lit("invalid"))
    assert aggregate.universal(bad, ["g"]).first().universal == 0.0


def test_presets():
    assert len(config.PRESETS) == 7
    assert config.preset("minimal").enabled() == [
        "token_semantics",
        "document_semantics",
        "dependency_parse",
        "pos_sequence",
    ]
    assert config.preset("dementia_detector").enabled() == ["token_semantics", "document_semantics", "constituency_parse"]
    assert config.preset("dementia_detector_pure").enabled() == ["document_semantics"]
    with pytest.raises(ValueError):
        config.preset("nope")


def test_composite(spark):
    weights = config.composite_weights("effect_size")
    assert weights == {"doc_semantic": 0.621, "token_semantic": 0.290, "syntactic_const": 0.247}
    assert set(config.composite_weights("significance")) == set(weights)
    assert config.composite_weights("hybrid")["token_semantic"] == pytest.approx(0.29 * -math.log10(0.0013))
    assert sum(config.composite_weights(available=["doc_semantic", "token_semantic"]).values()) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        config.composite_weights("effect_size", min_effect=2.0)
    df = table(spark, {"doc_semantic": 4.292, "token_semantic": 1000.0, "syntactic_const": 1.0})
    want = (0.621 * 0.5 + 0.290 * 1.0 + 0.247 * 0.5) / (0.621 + 0.290 + 0.247)
    assert aggregate.dementia_detector(df, ["g"]).first().composite == pytest.approx(want)
    assert aggregate.composite(table(spark, {"other": 1.0}), ["g"]).first().composite == 0.0
    got = {r.metric: r.score for r in aggregate.metric_scores(df, ["g"], ["doc_semantic", "rhythmic"]).collect()}
    assert got["doc_semantic"] == 4.292 and math.isnan(got["rhythmic"])


def test_profile_vector(spark):
    raw = {"token_semantics": 0, "document_semantics": 1, "dependency_parse": 5, "rhythmic": 1e9, "odd": 4}
    row = profiles.assemble(table(spark, raw), ["g"]).first().profile
    want = [0, math.log(2) / 4, math.log(6) / 3, 0, 0, 1.0, 0]
    assert row == pytest.approx(want)
    assert profiles.assemble(table(spark, raw), ["g"], normalized=False).first().profile[2] == 5.0
    matrix = spark.createDataFrame([([1.0, 2.0],)], "profile array<double>")
    with pytest.raises(Exception, match="7 positions"):
        profiles.normalize_matrix(matrix).collect()


def last_window(n, w, s):
    owner = [None] * n
    for i in range(0, n, s):
        for j in range(i, min(i + w, n)):
            owner[j] = i
    return owner


@pytest.mark.parametrize("window,stride", [(3, 1), (5, 3), (2, 4)])
def test_windows(spark, window, stride):
    texts = ["a b c", "a", "a a b", "d e", "a b", "f f f", "g", "a g", "h i j", "a", "k"]
    df = spark.createDataFrame([(i * 10, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = profiles.document_profiles(
        df,
        {"rhythmic": metrics.type_token_ratio()},
        window=window,
        stride=stride,
        order_by="doc_id",
        normalized=False,
    )
    got = {r.doc_id // 10: r.profile[5] for r in out.collect()}
    for j, start in enumerate(last_window(len(texts), window, stride)):
        if start is None:
            assert got[j] == 0.0
            continue
        words = " ".join(texts[start : start + window]).split()
        assert got[j] == pytest.approx(len(set(words)) / len(words)), j


def test_document_profiles_and_given_scores(spark):
    docs = [(1, "One thing. Another thing! A third one?"), (2, "word"), (3, "  "), (4, "Two words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    chosen = {"document_semantics": metrics.type_token_ratio(), "dependency_parse": metrics.type_token_ratio(), "pos_sequence": metrics.type_token_ratio()}
    got = {r.doc_id: r.profile for r in profiles.document_profiles(df, chosen, normalized=False).collect()}
    # Seven words in chunks of three: one and thing come twice.
    assert got[1][1] == pytest.approx(5 / 7) and got[1][2] == pytest.approx(5 / 7)
    assert got[2][1] == 0.0 and got[2][2] == pytest.approx(1 / 20) and got[2][4] == 0.25
    assert got[3] == [0.0] * 7
    assert got[4][1] == 1.0 and got[4][4] == 0.5
    given = spark.createDataFrame([(2, "document_semantics", 9.0), (3, "document_semantics", 9.0)], "doc_id long, metric string, score double")
    got = {r.doc_id: r.profile for r in profiles.document_profiles(df, chosen, normalized=False, precomputed=given).collect()}
    assert got[2][1] == 9.0 and got[2][2] == pytest.approx(1 / 20) and got[3] == [0.0] * 7


def test_all_seven_from_text(spark):
    texts = ["The cat sat, on the mat.", "A dog ran home.", "Birds fly, south, in winter."]
    df = spark.createDataFrame([("n", i, t) for i, t in enumerate(texts)], "n string, doc_id long, text string")
    scores = profiles.compute_scores(df, ["n"], metrics.text_metrics())
    got = {r.metric: r.score for r in scores.collect()}
    assert set(got) == set(config.PROFILE_METRICS)
    assert all(1.0 <= v <= 20 for v in got.values())


def test_constant_group_has_no_correlation(spark):
    from effnum.operators import evaluate

    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", 3.0, float("nan"))], "g string, x double, y double")
    assert {r.g: r.r for r in evaluate.pearson(df, ["g"], "x", "y").collect()} == {"a": None, "b": 1.0}
    assert {r.g: r.rho for r in evaluate.spearman(df, ["g"], "x", "y").collect()} == {"a": None, "b": 1.0}
