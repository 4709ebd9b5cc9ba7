"""The training-data operators on small inputs, against brute force and on odd rows."""

import hashlib
import html
import re

import numpy as np
import pytest

import corpus_pipeline
from effnum.llm import bpe, common, forest, html_blocks, language, line_dedup, mixing, near_duplicates, topk_pivot, toxicity, url_trees
from effnum.llm.common import read
from effnum.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _d int, text2 string"


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing and further columns."""
    long = "word " * 30_000 + "x" * 5_000
    rows = [(1, None, "en", None, None), (2, "", None, "a", 0), (3, long, "en", "a", 1), (4, long, "en", "a", 1), (4, long, "en", "a", 1),
            (None, "some text without an id at all", "de", "b", 3), (6, "\n\n  \n", "de", "b", 3), (7, "one two", "fr", "b", 3)]
    return spark.createDataFrame([(*r, 5, "y") for r in rows], DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = [t for (t,) in read(spark, SF, "documents").select("text").collect()]
    texts += ["ΑΣ Σ", "a<|endoftext|>b", "don't I'LL", "½ ² Ⅷ", "aaaabbbbabab", "a\x1cb\x85c\u3000d", "日本語", "", "\u0130"]
    own = bpe.WordBpe(path)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.written(text)[1] == library.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.round_trip(odd, path).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].ids_sha256 == sha("")
    assert got[4].decoded_sha256 == got[3].decoded_sha256
    assert bpe.round_trip(odd, path).count() == odd.count()
    assert bpe.encode(empty, path).count() == 0


def test_line_dedup_cases(spark, odd, empty):
    line = "a line of more than twenty characters"
    docs = spark.createDataFrame([(1, f"{line}\nx"), (2, f" {line.upper()}\t"), (3, f"{line}\n{line}"), (4, "short\nshort"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.digest(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_dropped, got[1].kept_sha256) == (1, sha("x"))
    assert (got[2].n_dropped, got[2].kept_sha256) == (1, sha(""))
    assert got[3].n_dropped == got[4].n_dropped == 0
    assert (got[5].n_lines, got[5].kept_sha256) == (1, sha(""))
    assert line_dedup.digest(odd).count() == odd.count() and line_dedup.digest(empty).count() == 0


def test_mixing_meets_its_targets(spark, odd, empty):
    docs = read(spark, SF, "documents")
    rows = mixing.digest(docs).toPandas()
    for _, g in rows.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert (rows.taken <= 3 * rows["size"]).all()
    assert abs(rows.drop_duplicates("source_size").target.sum() - rows["size"].sum()) < 1e-3 * rows["size"].sum() + 1
    assert mixing.digest(docs).toPandas().sort_values("doc_id").taken.tolist() == rows.sort_values("doc_id").taken.tolist()
    assert mixing.digest(odd).count() == odd.count() and mixing.digest(empty).count() == 0
    assert set(mixing.repeat(odd).columns) == set(odd.columns)


def brute_components(docs):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    first = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0 and first[a] != first[b]:
                lo, hi = sorted((first[a], first[b]))
                first = {d: lo if f == hi else f for d, f in first.items()}
    return {d: (len(sets[d]), first[d]) for d in sets}


def test_jaccard_join_equals_brute_force(spark, odd, empty):
    docs = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    words = [f"w{i}" for i in range(60)]
    for k in range(12):  # a chain: neighbours are similar, the ends are not
        docs.append((10_000 + k, " ".join(words[k * 2 : k * 2 + 40])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.digest(df).collect()}
    assert got == brute_components(docs)
    strange = near_duplicates.digest(odd).collect()
    assert len(strange) == odd.count()
    assert {r.component_id for r in strange if r.doc_id == 4} == {3}
    assert near_duplicates.digest(empty).count() == 0
    kept = near_duplicates.keep_first(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 0


def test_jaccard_join_counts_all_links(spark, empty, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HEIGHT", 3)  # one component is many blocks
    monkeypatch.setattr(near_duplicates, "COLUMNS", 5)
    docs = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    words = [f"w{i}" for i in range(60)]
    docs += [(10_000 + k, " ".join(words[k : k + 40 + k % 3])) for k in range(12)] + [(10_020, " ".join(words[:40])), (10_021, ""), (10_022, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0}
    got = {r.doc_id: r.n_links for r in near_duplicates.digest(df).collect()}
    assert got == {d: sum(d in p for p in want) for d in sets} and len(want) > 30
    pairs, members = near_duplicates.exact_links(df)
    pairs, of = [tuple(r) for r in pairs.collect()], {}
    for d, s in members.collect():
        of.setdefault(s, []).append(d)
    found = [tuple(sorted((x, y))) for a, b in pairs for x in of[a] for y in of[b]]
    found += [(x, y) for s, ds in of.items() if s is not None for x in ds for y in ds if x < y]
    assert len(found) == len(set(found)) and set(found) == want
    assert near_duplicates.exact_links(empty)[0].count() == 0


def test_keep_first_decides_by_row(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(None, one), (None, one), (None, two), (None, ""), (None, None), (5, one + " x"), (7, three), (7, two + " y z"), (7, three), (8, three + " x"),
            (9, ""), (9, ""), (7, "q r s"), (None, "t u v"), (None, "t u v")]
    kept = near_duplicates.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, ""), (None, None), (5, one + " x"), (7, three), (7, two + " y z"), (9, ""), (9, ""), (7, "q r s"), (None, "t u v")]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    for n in [1, 2, 3, 4, 5, 7, 9, 14, 30, 100, 400]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = rng.integers(0, len(a) // 5 + 1)
            b = np.sort(rng.permutation(a)[: len(a) - drop])
            if len(b) and near_duplicates.similar(a, b):
                g, owner = near_duplicates.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert set(g[owner == 0]) & set(g[owner == 1])


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)]
    rows += [(400, rows[0][1]), (420, None), (440, [float("nan")] * 8), (460, [0.0] * 8), (480, []), (None, [1.0] * 8), (0, rows[0][1])]
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, p int")


def test_pivot_search_is_exact(spark):
    df = vectors(spark)
    rows = {r.vec_id: np.floor(np.array(r.embedding) * 256) for r in df.collect() if r.vec_id is not None and r.embedding and not np.isnan(r.embedding).any()}
    got = {}
    for r in topk_pivot.digest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in rows if i % 50 == 0}
    for q, found in got.items():
        want = sorted(((-int(rows[q] @ v), i) for i, v in rows.items() if i != q))[:5]
        assert [found[k] for k in range(1, 6)] == [(i, -s) for s, i in want]
    assert topk_pivot.digest(df.limit(0)).count() == 0


def test_forest_recall_and_cases(spark):
    table = read(spark, SF, "embeddings")
    got = forest.digest(table).toPandas()
    e = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    hits = 0
    for q, g in got.groupby("query_id"):
        want = sorted((-(e[q] @ v), i) for i, v in e.items() if i != q)[:20]
        hits += len({i for _, i in want} & set(g.vec_id))
        assert g.sort_values("rank").score.is_monotonic_decreasing
    assert hits / len(got) >= 0.9
    df = vectors(spark)
    assert 460 not in set(forest.digest(df).toPandas().vec_id) and forest.digest(df.limit(0)).count() == 0


def test_searches_keep_lengths_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk_pivot, "ANNULUS", 7)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8)) for i in range(120)] + [(i, rng.normal(size=9)) for i in range(100, 140)] + [(777, rng.normal(size=3))]
    rows += [(100, rng.normal(size=8)) for _ in range(20)] + [(7, rng.normal(size=8)) for _ in range(20)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")

    def want(rows, step, k):
        out = {}
        for q, v in rows:
            if q % step == 0:
                out.setdefault(q, []).extend((-float(v @ w), i) for i, w in rows if i != q and len(w) == len(v))
        return {(q, r + 1, i, round(-s, 6)) for q, found in out.items() for r, (s, i) in enumerate(sorted(found)[:k])}

    whole = [(i, np.floor(v * 256)) for i, v in rows]
    assert {tuple(r) for r in topk_pivot.digest(df).collect()} == want(whole, 50, 5)
    clean = forest.clean(df, zero=False)
    got = forest.search(clean, clean.where("id % 20 = 0"), 20, visits=1.0).collect()
    assert {(*r[:3], round(r.score, 6)) for r in got} == want(rows, 20, 20)


def test_forest_gives_all_candidates_of_small_tables(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(16)] + [(0, rng.normal(size=8).tolist()) for _ in range(30)]
    df = spark.createDataFrame([*rows, *((100 + i, rng.normal(size=5).tolist()) for i in range(25))], "vec_id long, embedding array<double>")
    found = {}
    for r in forest.digest(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(found[100]) == 20
    few = spark.createDataFrame(rows[:16], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in forest.digest(few).collect()} == set(range(1, 16))


def test_main_text_is_the_article(spark):
    pages = read(spark, SF, "pages")
    net = html_blocks.fit(pages)
    want = {}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", inside))
        want[r.page_id] = "\n\n".join(x for x in parts if x)
    got = {r.page_id: r.text for r in html_blocks.extract(pages, net).collect()}
    assert got == want
    strange = spark.createDataFrame([(1, None, None, 1), (1, "u", "", 1), (2, "u", "<p>unclosed <!-- x", 1), (3, "u", "<script>a</p>", 1)], "page_id long, url string, html string, text int")
    assert [r.n_chars == len(r.text) for r in html_blocks.extract(strange, net).collect()] == [True] * 4
    assert html_blocks.digest(strange.limit(0)).count() == 0


def test_url_rules(spark):
    urls = [None, "nourl", "http://NET/es/a?b#c", "x://a.net", "http://www.EXAMPLE.com/en/1", "https://example.com/en/", "https://a.example.com?x=/en/", "http://notexample.com/en/"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_trees.judge(df).collect()}
    assert [got[i].rule for i in range(8)] == [None, None, "net/es/", None, "www.example.com/en/", "example.com/en/", None, "com/"]
    assert (got[2].host, got[2].path, got[2].verdict) == ("net", "/es/a", "block")
    assert (got[0].host, got[0].path) == ("", "") and got[6].path == ""
    assert url_trees.judge(df.limit(0)).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((url_trees.Boosted(x[:1000], y[:1000]).probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.9


def test_language_accuracy_and_cases(spark, odd, empty):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = language.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.9
    strange = language.digest(odd).collect()
    assert len(strange) == odd.count() and {r.lang_pred for r in strange if r.doc_id in (1, 2, 6)} == {"und"}
    assert language.digest(empty).count() == 0


def test_toxicity_accuracy_and_cases(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    got = toxicity.digest(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    strange = toxicity.digest(odd, labels).collect()
    assert len(strange) == odd.count() and all(0 <= r.score <= 1 for r in strange)
    assert toxicity.digest(empty, labels).count() == 0
    assert toxicity.digest(odd, labels.limit(0)).count() == odd.count()


def test_bounded_sample_is_the_same_beyond_a_broadcast(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('l', id % 7)) AS y", "1 AS more")
    few = {tuple(r) for r in common.bounded_sample(rows, "y", "id", 20, 1000).select("id", "y").collect()}
    monkeypatch.setattr(common, "LABELS", 0)
    assert {tuple(r) for r in common.bounded_sample(rows, "y", "id", 20, 1000).select("id", "y").collect()} == few
    assert len(few) == 20 * 8


def test_pipeline_stages(spark):
    docs = read(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and len(QUERIES) == 13
