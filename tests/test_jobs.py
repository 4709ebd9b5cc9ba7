import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from effnum.operators import corpora, encode, estimate, evaluate, ordinals, ranking, selection
from effnum.plans import metrics
from effnum.sources import corpus as sources
from effnum.sources import files
from effnum.streaming import windows


def test_ladder():
    assert estimate.ladder(50, 200, 2.0) == [50, 100, 200]
    assert estimate.ladder(150, 200, 2.0) == [150, 200]


def test_growth_curves():
    sizes = [50, 100, 200, 400, 800]
    model, a, b, c, rmse = estimate.fit_curve(sizes, [2 * math.log(n + 1) + 0.5 for n in sizes])
    assert model == "power_law" and rmse < 0.1
    model, a, b, c, rmse = estimate.fit_curve(sizes, sizes)
    assert a * 1000**b + c == pytest.approx(1000, rel=1e-6)
    model, a, b, c, rmse = estimate.fit_curve(sizes[:4], [1.0, 1.6, 2.1, 2.5], prefer_asymptotic=True)
    assert model == "asymptotic" and 0 < a * (1 - math.exp(-1000 / b)) + c < 5


def test_estimation(spark):
    rows = [("big", i, f"w{i}") for i in range(1000)] + [("small", i, "same") for i in range(10)]
    df = spark.createDataFrame(rows, "g string, doc_id long, text string")

    def species(corpus, by):
        return corpus.groupBy(*by).agg(F.countDistinct("text").cast("double").alias("diversity"))

    got = {r.g: r for r in estimate.estimate_diversity(df, ["g"], species).collect()}
    assert got["small"].method == "direct" and got["small"].diversity == 1.0 and got["small"].ci95 == [1.0, 1.0]
    big = got["big"]
    assert big.method == "extrapolation" and big.sample_sizes == [50, 100, 200] and big.means == [50, 100, 200]
    assert big.diversity == pytest.approx(1000, rel=1e-3) and big.std == 0.0 and big.corpus_size == 1000
    again = {r.g: r for r in estimate.estimate_diversity(df, ["g"], species).collect()}
    assert again == got
    broken = estimate.estimate_diversity(
        df, ["g"], lambda c, by: c.groupBy(*by).agg(F.lit(float("nan")).alias("diversity"))
    )
    assert {r.g: r.method for r in broken.collect()}["big"] == "error"


def test_uncertainty_grows_with_distance(spark):
    rows = [("g", i, "a" if i % 3 else f"w{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, doc_id long, text string")
    out = estimate.estimate_diversity(df, ["g"], metrics.type_token_ratio(), trials=4).first()
    mean = sum(out.stds) / len(out.stds)
    assert out.std == pytest.approx(mean * (math.log2(900 / 200) + 1))
    assert out.ci95[1] - out.ci95[0] == pytest.approx(2 * 1.96 * out.std)


def test_ranking(spark):
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "query_id string, vec array<double>")
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(40)]
    c = spark.createDataFrame(rows, "doc_id long, vec array<double>")
    got = ranking.rank_similarity(q, c, k=3).collect()
    for name, axis in (("a", 0), ("b", 1)):
        want = sorted(rows, key=lambda r: (-r[1][axis], r[0]))[:3]
        mine = sorted((r for r in got if r.query_id == name), key=lambda r: r["rank"])
        assert [r.id for r in mine] == [w[0] for w in want]
        assert [r.score for r in mine] == pytest.approx([w[1][axis] for w in want])
    assert ranking.rank_similarity(q, c, k=-1).count() == 80


def test_ordinals_across_partitions(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id").alias("v")).repartition(7)
    got = ordinals.ordinal(df, ["g"], ["v"]).collect()
    assert all(r.pos == r.v // 2 for r in got) and len(got) == 500


def clustered():
    rng = np.random.default_rng(0)
    x = np.zeros((12, 4))
    for k in range(12):
        x[k, k // 4] = 5.0
    return x + rng.normal(scale=0.05, size=x.shape)


def points(spark, x, g="g"):
    return spark.createDataFrame([(g, i, [float(v) for v in r]) for i, r in enumerate(x)], "g string, id long, vec array<double>")


@pytest.mark.parametrize("method", selection.METHODS)
def test_selection_contract(spark, method):
    df = points(spark, clustered())
    rows = selection.select_diverse(df, 3, method, by=["g"]).orderBy("rank").collect()
    ids = [r.id for r in rows]
    assert len(set(ids)) == 3 and [r["rank"] for r in rows] == [1, 2, 3]
    if method != "balanced":
        assert {i // 4 for i in ids} == {0, 1, 2}
    assert [r.id for r in selection.select_diverse(df, 3, method, by=["g"]).orderBy("rank").collect()] == ids
    assert selection.select_diverse(df, 50, method, by=["g"]).count() == 12


@pytest.mark.parametrize("method", selection.METHODS)
def test_distributed_selection_equals_one_task(spark, method, monkeypatch):
    from effnum.operators import blocks

    rng = np.random.default_rng(3)
    df = points(spark, rng.normal(size=(40, 3))).unionByName(points(spark, rng.normal(size=(4, 3)), "h"))
    want = selection.select_diverse(df, 4, method, by=["g"]).collect()
    monkeypatch.setattr(selection, "GROUP_ROWS", 20)
    monkeypatch.setattr(blocks, "rows_per_block", lambda dim: 15)
    got = selection.select_diverse(df, 4, method, by=["g"]).collect()
    key = lambda r: (r.g, r["rank"])
    for a, b in zip(sorted(want, key=key), sorted(got, key=key), strict=True):
        assert (a.g, a["rank"], a.id) == (b.g, b["rank"], b.id) and a.score == pytest.approx(b.score, abs=1e-9)


@pytest.mark.parametrize("method", ["facility_location", "max_min"])
def test_lazy_steps_choose_what_greedy_chooses(spark, method, monkeypatch):
    """Few rows settled at a time, repeated vectors, so gains tie."""
    from effnum.operators import blocks

    x = np.random.default_rng(5).normal(size=(25, 3))
    df = points(spark, np.vstack([x, x[:5]]))
    k = 4 if method == "facility_location" else 9
    want = [r.id for r in selection.select_diverse(df, k, method, by=["g"]).orderBy("rank").collect()]
    monkeypatch.setattr(selection, "GROUP_ROWS", 20)
    monkeypatch.setattr(selection, "LAZY", 10)
    monkeypatch.setattr(blocks, "rows_per_block", lambda dim: 15)
    passes = []
    kept = selection._all_pairs
    monkeypatch.setattr(selection, "_all_pairs", lambda *a: passes.append(1) or kept(*a))
    got = [r.id for r in selection.select_diverse(df, k, method, by=["g"]).orderBy("rank").collect()]
    assert got == want
    # All pairs are not met once per choice.
    if method == "facility_location":
        assert len(passes) < k


@pytest.mark.parametrize("method", selection.METHODS)
def test_scalable_selection_measures_winners_on_whole_groups(spark, method, monkeypatch):
    """Equal to greedy over the parts' winners with gains over all rows, at any size of a group."""
    from effnum.operators import blocks

    monkeypatch.setattr(selection, "GROUP_ROWS", 20)
    monkeypatch.setattr(blocks, "rows_per_block", lambda dim: 15)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    df = points(spark, x).unionByName(points(spark, rng.normal(size=(4, 3)), "h"))
    rows = selection.select_diverse(df, 4, method, by=["g"], mode="scalable").collect()
    exact = selection.select_diverse(df, 4, method, by=["g"]).collect()
    # A group of one part is chosen from as in the exact mode, whatever other groups hold.
    assert {(r["rank"], r.id) for r in rows if r.g == "h"} == {(r["rank"], r.id) for r in exact if r.g == "h"}
    got = [r.id for r in sorted(rows, key=lambda r: r["rank"]) if r.g == "g"]
    assert len(set(got)) == 4
    if method == "balanced":
        return
    src = selection._prepared(df.where("g = 'g'"), ["g"], "id", "vec", None, method, "cosine", 42)
    pool = sorted(r.sid for r in selection._winners(src, ["g"], 4, method, "cosine", 0.5).collect())
    assert 4 < len(pool) < 40
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    z, chosen = u @ u.T, [got[0]]
    if method == "facility_location":
        assert got[0] == max(pool, key=lambda c: z[:, c].sum())
    while len(chosen) < 4:
        if method == "facility_location":
            held = np.maximum(z[:, chosen].max(1), 0)
            chosen.append(max((c for c in pool if c not in chosen), key=lambda c: np.maximum(z[:, c] - held, 0).sum()))
        else:
            chosen.append(min((c for c in pool if c not in chosen), key=lambda c: z[c, chosen].max()))
    assert got == chosen


@pytest.mark.parametrize("threshold", [0.5, 0.02])
def test_balanced_selection_equals_its_definition(spark, threshold):
    raw = np.abs(np.random.default_rng(8).normal(size=(14, 3)))
    unit = [[float(v) / float(np.sqrt((r**2).sum())) for v in r] for r in raw]
    near = lambda a, b: sum(u * v for u, v in zip(unit[a], unit[b]))
    chosen = []
    for _ in range(5):
        held = [[max([near(i, j) * abs(unit[j][m]) for j in chosen], default=0.0) for m in range(3)] for i in range(14)]
        mean = [sum(h[m] for h in held) / 14 for m in range(3)]
        low = min(range(3), key=lambda m: mean[m])
        dims, single = ([low], True) if mean[low] < threshold else (range(3), False)

        def gain(c, m):
            return sum(max(held[i][m], near(i, c) * (1.0 if single else unit[c][m])) for i in range(14)) / 14 - mean[m]

        chosen.append(max((c for c in range(14) if c not in chosen), key=lambda c: (min(gain(c, m) for m in dims), -c)))
    rows = selection.balanced(points(spark, raw), 5, by=["g"], threshold=threshold).orderBy("rank").collect()
    assert [r.id for r in rows] == chosen


def test_selection_weights_and_errors(spark):
    df = points(spark, clustered())
    with pytest.raises(ValueError):
        selection.select_diverse(df, 2, "nope", by=["g"])
    with pytest.raises(Exception, match="weights"):
        selection.select_diverse(df, 2, by=["g"], weights=[1.0]).collect()
    assert selection.select_diverse(df, 2, by=["g"], weights=[1.0, 0.0, 0.0, 0.0]).count() == 2


def test_selection_summary(spark):
    x = clustered()
    df = points(spark, x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    picks = selection.select_diverse(df, 3, by=["g"])
    ids = [r.id for r in picks.collect()]
    row = selection.summary(df, picks, by=["g"]).first()
    want = [(u[:, [m]] @ u[ids][:, [m]].T).max(1).mean() for m in range(4)]
    assert row.coverage == pytest.approx(want)
    assert row.metadata["total_coverage"] == pytest.approx((u @ u[ids].T).max(1).sum())
    row = selection.summary(df, picks, "max_min", by=["g"]).first()
    s = u[ids] @ u[ids].T
    assert row.coverage == pytest.approx(list(u[ids].std(0)))
    assert row.metadata["diversity_score"] == pytest.approx(1 - (s.sum() - 3) / 6)


def test_evaluation(spark):
    rows = [("a", 1, 10.0, 1.0), ("a", 2, 10.0, 2.0), ("a", 3, 30.0, 2.0), ("a", 4, None, 9.0), ("a", 5, 40.0, 7.0)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double")
    want = np.corrcoef([1.5, 1.5, 3, 4], [1, 2.5, 2.5, 4])[0, 1]
    got = evaluate.spearman(df, ["g"], "x", "y").first()
    assert got.n == 4 and got.rho == pytest.approx(want)
    board = evaluate.leaderboard(spark.createDataFrame([(0.5,), (1.1,), (2.0,)], "s double"), "s", "near_one")
    assert [r.s for r in board.collect()] == [1.1, 0.5, 2.0]
    scores = spark.createDataFrame(
        [("c1", "self_bleu", 0.2), ("c2", "self_bleu", 0.9), ("c1", "m", 3.0), ("c2", "m", 3.0), ("c2", "l", 1.0)],
        "corpus string, metric string, score double",
    )
    contrasts = spark.createDataFrame([("semantic", "inverse_pair", "c1", "c2")], "level string, kind string, greater string, lesser string")
    got = {r.metric: r.accuracy for r in evaluate.contrast_accuracy(contrasts, scores).collect()}
    assert got == {"self_bleu": 1.0, "m": 0.0}
    checks = spark.createDataFrame([("c2", "syntactic", "morphological")], "corpus string, greater_level string, lesser_level string")
    assert evaluate.within_corpus(checks, scores, {"syntactic": "m", "morphological": "l"}).first().satisfied
    grid = evaluate.score_grid(
        spark.createDataFrame([("p", 1, "a b"), ("p", 2, "a"), ("q", 1, "a")], "corpus string, doc_id int, text string"),
        "corpus",
        {"ttr": metrics.type_token_ratio()},
    )
    got = {r.corpus: r.score for r in grid.collect()}
    assert got["p"] == pytest.approx(2 / 3) and math.isnan(got["q"])


def test_synonymy_corpora(spark):
    rows = [(f"c{d}{k}", f"d{d}", [f"c{d}{k}-{t}" for t in range(4)]) for d in range(3) for k in range(4)]
    clusters = spark.createDataFrame(rows, "id string, domain string, paraphrases array<string>")
    got = corpora.synonymy_corpora(clusters).collect()
    by_id = {r.id: r for r in got}
    assert len(by_id) == len(got) == 36 + 24  # no domain has six concepts
    for r in got:
        k, m = int(r.true_diversity), r.n_documents // int(r.true_diversity)
        assert len(set(r.concept_labels)) == k and r.n_documents == k * m == len(set(r.documents))
        assert all(d.startswith(c) for d, c in zip(r.documents, r.concept_labels, strict=True))
        domains = {c[1] for c in r.concept_labels}
        assert len(domains) == (min(k, 3) if r.regime == "cross_domain" else 1)
    assert {r.id: r.documents for r in corpora.synonymy_corpora(clusters).collect()} == {r.id: r.documents for r in got}


def test_constructions_and_contrasts(spark):
    sets = spark.createDataFrame([("s1", list("abcd")), ("s2", list("efg"))], "id string, texts array<string>")
    frames = spark.createDataFrame([(f"f{k}", [f"f{k}{t}" for t in range(5)]) for k in range(4)], "id string, texts array<string>")
    alts = corpora.subsampled_sets(sets, "syntactic_alternations", "alt")
    assert sorted((r.id, r.n_documents) for r in alts.collect()) == [
        ("alt-s1-n2", 2), ("alt-s1-n3", 3), ("alt-s1-n4", 4), ("alt-s2-n2", 2), ("alt-s2-n3", 3),
    ]
    grid = corpora.grid_sets(frames, "syntactic_frames", "frame")
    rows = grid.collect()
    assert len(rows) == 24
    assert all(r.expected["semantic"] == r.n_documents and r.expected["rhythmic"] is None for r in rows)
    pool = frames.select(F.explode("texts").alias("text")).select(F.col("text").alias("id"), "text")
    randoms = corpora.random_controls(pool)
    assert {r.n_documents for r in randoms.collect()} == {2, 3, 4, 6, 8, 9, 12}
    records = alts.unionByName(grid).unionByName(randoms)
    pairs = corpora.contrasts(records).collect()
    inverse = [p for p in pairs if p.kind == "inverse_pair" and p.level == "semantic"]
    # Two corpora of 2, two of 3 and one of 4 documents, three partners each.
    assert len(inverse) == 15 and all(p.greater.startswith("frame") for p in inverse)
    ceiling = [p for p in pairs if p.kind == "ceiling"]
    assert len(ceiling) == 5 and all(p.greater.startswith("random") for p in ceiling)
    assert corpora.as_corpus(alts).count() == 14


def test_files(spark, tmp_path):
    record = {"id": "c", "family": "f", "documents": ["x", "y"], "n_documents": 2, "expected": {"semantic": 2.0, "rhythmic": None}}
    inside = {"level": "__within_corpus__", "corpus": "c", "greater_level": "s", "lesser_level": "m"}
    plain = {"level": "semantic", "kind": "k", "greater": "a", "lesser": "b"}
    (tmp_path / "b.json").write_text(json.dumps({"corpora": [record], "contrasts": [plain, inside]}, indent=1))
    row = files.read_corpora(spark, str(tmp_path / "b.json")).first()
    assert row.documents == ["x", "y"] and row.expected == {"semantic": 2.0, "rhythmic": None}
    between, within = files.read_contrasts(spark, str(tmp_path / "b.json"))
    assert between.first().greater == "a" and within.first().corpus == "c"
    for name in ("set_with_hds_story_gen.csv", "set_with_hds_prompt_gen.csv"):
        (tmp_path / name).write_text('sample_id,resp_0,resp_1,resp_2,resp_3,resp_4\n1,"a, b",c,,d,e\n')
    rows = files.read_scored_csv(spark, str(tmp_path / "*.csv"))
    assert sorted(r.domain for r in rows.collect()) == ["prompt_gen", "story_gen"]
    assert files.responses(rows, ["sample_id", "domain"]).count() == 8
    files.write_results(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    lines = sources.read_table(spark, str(tmp_path / "t.txt"), "text").withColumn("k", F.length("value"))
    assert sources.corpus(lines, "value", "k").columns == ["doc_id", "text"]
    with pytest.raises(ValueError):
        sources.read_table(spark, "x", "nope")


def test_encoders(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "red red"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.vec for r in encode.hashed_words(df, dim=512).collect()}
    assert sum(got[1]) == 2 and max(got[2]) == 2 and sum(got[3]) == 0
    assert all(abs(np.linalg.norm(r.vec) - 1) < 1e-9 for r in encode.tfidf(df, dim=512).collect() if r.doc_id == 1)
    vectors = encode.word_vectors(df, dim=4)
    means = {r.doc_id: r.vec for r in encode.mean_of_words(df, vectors).collect()}
    table = {r.word: r.vec for r in vectors.collect()}
    assert means[2] == pytest.approx(table["red"]) and means[3] is None


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", [float(i), 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "t string, vec array<double>").select(F.to_timestamp("t").alias("ts"), "vec")
    df.write.parquet(str(tmp_path / "in"))
    batch = windows.semantic_diversity(df, "ts", "vec", "1 day").collect()
    x = np.array([r[1] for r in rows if r[0].startswith("2024-01-01")])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    first = min(batch, key=lambda r: r.window.start)
    assert first.diversity == pytest.approx(1 / (u @ u.T).mean())
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = windows.semantic_diversity(stream, "ts", "vec", "1 day")
    run = out.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    run.processAllAvailable()
    run.stop()
    key = lambda r: r.window.start
    for a, b in zip(sorted(batch, key=key), sorted(spark.table("windows").collect(), key=key), strict=True):
        assert a.n_species == b.n_species and a.diversity == pytest.approx(b.diversity)


def test_registered_queries_are_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_pca_of_whole_vectors_equals_brute_force(spark):
    from workload import jobs

    folder = "/root/testdata/sf0.001"
    groups = {}
    for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect():
        groups.setdefault(r.label, []).append(r.embedding)
    got = {r.label: r for r in jobs.pca_whole_variance(spark, folder).collect()}
    assert set(got) == set(groups)
    for label, rows in groups.items():
        x = np.array(rows, float)
        assert x.shape[1] == 64 and got[label].n == len(x)
        values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
        want = values[:8].sum() if len(x) > 1 else (x * x).sum()
        assert got[label].total == pytest.approx(want, rel=1e-6)


def test_rounds_do_not_depend_on_larger_groups(spark, monkeypatch):
    monkeypatch.setattr(selection, "GROUP_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [("a", i, rng.normal(size=4).tolist()) for i in range(60)] + [("b", 1000 + i, rng.normal(size=4).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id long, vec array<double>")
    pick = lambda d: sorted((r["rank"], r.id) for r in selection.select_diverse(d, 10, by=["g"], mode="scalable").where("g = 'a'").collect())
    assert pick(df) == pick(df.where("g = 'a'"))
