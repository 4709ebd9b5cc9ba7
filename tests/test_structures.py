import itertools
import math
import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from effnum.operators import graphs, phonology, sequences, tokens, trees
from effnum.plans import metrics


def lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            keep = line[j + 1]
            line[j + 1] = before + 1 if x == y else max(line[j + 1], line[j])
            before = keep
    return line[-1]


def dense_hill(z):
    n = len(z)
    return math.exp(-np.log(z.mean(1) + 1e-10).sum() / n)


def sequence_matrix(seqs):
    longest = max(1, max(map(len, seqs)))
    z = np.array([[lcs(a, b) for b in seqs] for a in seqs], dtype=float) / longest
    np.fill_diagonal(z, 1.0)
    return z


@pytest.mark.parametrize("length", [5, 70, 200])
def test_sequence_diversity_equals_matrix(spark, tiny_blocks, length):
    rng = random.Random(length)
    groups = {
        "big": [[rng.choice("abc") for _ in range(rng.randint(0, length))] for _ in range(15)],
        "copies": [list("ab")] * 6 + [list("ba")] * 3,
        "lone": [list("xyz")],
        "void": [[], []],
    }
    rows = [(g, i, s) for g, seqs in groups.items() for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "g string, id int, tags array<string>")
    got = {r.g: r for r in sequences.sequence_diversity(df, ["g"]).collect()}
    for g, seqs in groups.items():
        assert got[g].diversity == pytest.approx(dense_hill(sequence_matrix(seqs))), g
        assert got[g].n_species == len(seqs)


def test_few_and_many_pairs_agree(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    a = [[rng.choice("abcd") for _ in range(rng.choice([0, 1, 63, 64, 65, 130]))] for _ in range(60)]
    b = [[rng.choice("abcde") for _ in range(rng.choice([0, 1, 63, 64, 65, 130]))] for _ in range(60)]
    want = [lcs(x, y) for x, y in zip(a, b, strict=True)]
    kind = pa.list_(pa.string())
    for few in (0, 10**9):
        monkeypatch.setattr(sequences, "FEW", few)
        assert sequences.score_pairs(pa.array(a, kind), pa.array(b, kind)).tolist() == want


def test_alignment_with_other_scores(spark):
    df = spark.createDataFrame([(list("gattaca"), list("gcatgcu")), (list("aa"), [])], "a array<string>, b array<string>")
    rows = [r[0] for r in df.select(sequences.alignment_score("a", "b", (1.0, -1.0, -1.0))).collect()]
    assert rows == [0.0, 0.0]


def test_padding_and_symbols(spark):
    df = spark.createDataFrame([("g", 1, ["N", "V"]), ("g", 2, ["A", "N", "V"]), ("g", 3, [])], "g string, id int, tags array<string>")
    padded = {r.id: r.tags for r in sequences.pad_to_longest(df, ["g"], "tags", "NULL").collect()}
    assert padded[1] == ["N", "V", "NULL"] and padded[3] == ["NULL"] * 3
    symbols = {r.id: r.symbols for r in sequences.tags_to_symbols(df, ["g"], "id", "tags").collect()}
    assert symbols == {1: "BC", 2: "ABC", 3: ""}


@lru_cache(None)
def forest_distance(f, g):
    if not f and not g:
        return 0
    if not f:
        return forest_distance(f, g[:-1] + g[-1][1]) + 1
    if not g:
        return forest_distance(f[:-1] + f[-1][1], g) + 1
    (a, below_a), (b, below_b) = f[-1], g[-1]
    return min(
        forest_distance(f[:-1] + below_a, g) + 1,
        forest_distance(f, g[:-1] + below_b) + 1,
        forest_distance(f[:-1], g[:-1]) + forest_distance(below_a, below_b) + (a != b),
    )


def random_tree(rng, n):
    return [(i, None if i == 0 else rng.randrange(max(0, i - 4), i), rng.choice("ab")) for i in range(n)]


def nested(rows):
    below = {}
    for node, parent, _ in rows:
        below.setdefault(parent, []).append(node)

    def build(i):
        return (rows[i][2], tuple(build(c) for c in below.get(i, ())))

    return build(0)


def test_tree_diversity_equals_matrix(spark, tiny_blocks):
    rng = random.Random(4)
    docs = {d: random_tree(rng, rng.randint(1, 8)) for d in range(12)}
    docs[12] = docs[0]
    rows = [("g", d, *r) for d, t in docs.items() for r in t]
    df = spark.createDataFrame(rows, "g string, doc_id int, node int, parent int, label string")
    got = trees.constituency_diversity(df, ["g"]).first()
    shapes = [nested(t) for t in docs.values()]
    z = np.array([[math.exp(-forest_distance((a,), (b,))) for b in shapes] for a in shapes])
    assert got.n_species == 13 and got.diversity == pytest.approx(dense_hill(z))


def parse(doc, words):
    return [("g", doc, i, h, p, d) for i, (h, p, d) in enumerate(words)]


def test_dependency_labels(spark):
    frame = [(1, "DET", "det"), (2, "NOUN", "nsubj"), (2, "VERB", "ROOT"), (4, "DET", "det"), (2, "NOUN", "dobj")]
    other = [(1, "PRON", "nsubj"), (1, "VERB", "ROOT"), (1, "ADV", "advmod")]
    schema = "g string, doc_id int, tok int, head int, pos string, dep string"
    same = spark.createDataFrame(parse(1, frame) + parse(2, frame), schema)
    mixed = spark.createDataFrame(parse(1, frame) + parse(2, other), schema)
    assert trees.dependency_diversity(same, ["g"]).first().diversity == pytest.approx(1.0)
    assert trees.dependency_diversity(mixed, ["g"]).first().diversity > 1.5
    lone = trees.dependency_trees(spark.createDataFrame(parse(1, [(0, "NOUN", "ROOT")]), schema), ["g"]).first()
    assert lone.tree.labels == ["NOUN:ROOT"]
    with pytest.raises(ValueError):
        trees.dependency_diversity(same, ["g"], similarity="graph_edit_distance")


def test_all_roots_count_and_edges_come_back(spark):
    rows = [("g", 1, 0, None, "S"), ("g", 1, 1, 0, "A"), ("g", 1, 2, 1, "B"), ("g", 1, 3, 0, "C"), ("g", 1, 4, None, "T")]
    df = spark.createDataFrame(rows, "g string, doc_id int, node int, parent int, label string")
    tree = trees.constituency_trees(df, ["g"])
    row = tree.first().tree
    assert row.labels == ["B", "A", "C", "S", "T", "ROOTS"] and row.left == [0, 0, 2, 0, 4, 0]
    edges = {r.node: r.parent for r in trees.tree_edges(tree, ["g"], "doc_id").collect()}
    assert edges == {0: 1, 1: 3, 2: 3, 3: 5, 4: 5, 5: None}


def test_whole_texts_are_parsed(spark):
    texts = [("Same start. One two three.",), ("Same start. A completely different, longer, tail here!",)]
    df = spark.createDataFrame([("g", k, *t) for k, t in enumerate(texts)], "g string, doc_id int, text string")
    for whole, single in (
        (metrics.dependency_parse(), metrics.dependency_parse(split_sentences=True)),
        (metrics.constituency_parse(), metrics.constituency_parse(split_sentences=True)),
    ):
        a, b = whole(df, ["g"]).first(), single(df, ["g"]).first()
        assert a.diversity > 1.5 and a.n_species == 2
        assert b.diversity > 1.5 and b.n_species == 4


def test_many_clauses_and_missing_texts(spark):
    df = spark.createDataFrame([("g", 1, "a," * 40000), ("g", 2, None), ("g", 3, "")], "g string, doc_id int, text string")
    counts = {r.doc_id: r["count"] for r in metrics.chunk_trees(df, ["g"]).groupBy("doc_id").count().collect()}
    assert counts == {1: 80001, 2: 1, 3: 1}
    assert metrics.head_first_parses(df, ["g"]).count() == 40000


def test_more_tags_than_one_byte(spark):
    tags = [f"t{k:03d}" for k in range(60000 // 200)]
    df = spark.createDataFrame([("g", 1, tags)], "g string, doc_id int, tags array<string>")
    out = sequences.tags_to_symbols(df, ["g"], "doc_id", "tags").first().symbols
    assert len(out) == len(set(out)) == 300 and out[0] == "A"


def test_degree_profile_and_feather(spark):
    star = [(1, 0, None), (1, 1, 0), (1, 2, 0), (1, 3, 0)]
    path = [(2, 0, None), (2, 1, 0), (2, 2, 1), (2, 3, 2)]
    df = spark.createDataFrame([*star, *path, (3, 0, None)], "doc_id int, node int, parent int")
    got = {r.doc_id: r.vec for r in graphs.local_degree_profile(df, [], bins=64).collect()}
    slot = lambda x: min(63, int(math.log1p(x) / 10 * 64))
    assert got[1][slot(3)] == 1.0 and got[1][slot(1)] == 3.0 and got[1][64 + slot(3)] == 3.0
    assert sum(got[2]) == 5 * 4 and got[3][slot(0)] == 1.0
    waves = {r.doc_id: r.vec for r in graphs.feather(df, [], order=2, points=3).collect()}
    t = 2.5 / 3
    hub, leaf = math.log1p(3), math.log1p(1)
    first = (math.cos(t * leaf) + 3 * math.cos(t * hub)) / 4
    assert waves[1][0] == pytest.approx(first) and len(waves[1]) == 12 and set(waves[3]) == {0.0}


def token_rows(spark, rows):
    return spark.createDataFrame(rows, "g string, doc_id int, pos int, token string, vec array<double>")


def merged(df, **options):
    rows = tokens.merge_subwords(df, ["g"], **options).orderBy("doc_id", "word_no").collect()
    return [(r.doc_id, r.word, r.vec) for r in rows]


def test_merge_subwords(spark):
    v = [0.0, 0.0]
    pieces = ["col", "##oss", "##al", "world"]
    df = token_rows(spark, [("g", 1, i, t, v) for i, t in enumerate(pieces)])
    assert [w for _, w, _ in merged(df)] == ["colossal", "world"]
    started = ["Ġcol", "oss", "al", "Ġworld"]
    df = token_rows(spark, [("g", 1, i, t, v) for i, t in enumerate(started)])
    assert [w for _, w, _ in merged(df)] == ["colossal", "world"]
    df = token_rows(spark, [("g", 1, 0, "a", [0.0, 0.0]), ("g", 1, 1, "##b", [2.0, 4.0])])
    assert merged(df) == [(1, "ab", [1.0, 2.0])]
    across = [("g", 1, 0, "Ġa", v), ("g", 1, 1, "b", v), ("g", 2, 0, "c", v), ("g", 2, 1, "d", v)]
    assert [(d, w) for d, w, _ in merged(token_rows(spark, across))] == [(1, "ab"), (2, "cd")]
    lead = token_rows(spark, [("g", 1, 0, "##oss", v), ("g", 1, 1, "##al", v)])
    assert [w for _, w, _ in merged(lead)] == ["ossal"]
    plain = token_rows(spark, [("g", 1, 0, "a", v), ("g", 1, 1, "b", v)])
    assert [w for _, w, _ in merged(plain)] == ["a", "b"]
    with pytest.raises(ValueError):
        tokens.merge_subwords(plain, ["g"], scheme="nope")


def test_token_filters_run_before_merging(spark):
    rows = [("g", 1, i, t, [float(i == k) for k in range(6)]) for i, t in enumerate(["[CLS]", "the", "cat", "!", "sat", "cat"])]
    df = token_rows(spark, rows)
    out = tokens.token_diversity(
        df, ["g"], special=["[CLS]", None], stopwords=["the"], remove_punctuation=True, mean_adjust=False
    ).first()
    assert out.n_species == 3 and out.diversity == pytest.approx(3.0) and out.saturated
    assert "the" in tokens.english_stopwords()


def test_rhythm(spark):
    from effnum.functions import sound as so

    words = ["cat", "bee", "boat", "cow", "ba", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(so.syllable_weight(F.col("w"))).collect()] == [1, 1, 1, 1, 0, 0]
    text = spark.createDataFrame([(1, "The banana, café!"), (2, "..."), (3, "a banana")], "doc_id int, text string")
    codes = {r.doc_id: r.rhythm for r in phonology.rhythm_codes(text).collect()}
    assert codes[1] == ["10", "00"] and codes[2] == [""] and codes[3] == ["10", "00"]
    full = {r.doc_id: r.analysis for r in phonology.analyze(text).collect()}
    banana = full[3][1]
    assert [s.syllable for s in banana.syllables] == ["ba", "na", "na"]
    assert [s.stress for s in banana.syllables] == [0, 1, 0]


def test_lexicon_lookups(spark):
    lexicon = spark.createDataFrame(
        [("hello", ["HH", "AH0", "L", "OW1"], ["hel", "lo"], "INTJ")],
        "word string, phones array<string>, syllables array<string>, pos string",
    )
    text = spark.createDataFrame([(1, "Hello you"), (2, "")], "doc_id int, text string")
    got = {r.doc_id: r.rhythm for r in phonology.rhythm_codes(text, lexicon=lexicon).collect()}
    assert got[1] == ["01", "11"] and got[2] == [""]
    phones = {r.doc_id: r.phonemes for r in phonology.phonemes(text, lexicon=lexicon).collect()}
    assert phones == {1: "HH AH0 L OW1 y o u", 2: ""}
    dropped = {r.doc_id: r.phonemes for r in phonology.phonemes(text, lexicon=lexicon, unknown="drop").collect()}
    assert dropped[1] == "HH AH0 L OW1"
    tags = {r.doc_id: r.tags for r in phonology.pos_tags(text, "doc_id", "text", lexicon).collect()}
    assert tags == {1: ["INTJ", "X"], 2: []}


def test_rank_sequences_uses_the_longer_length(spark):
    q = spark.createDataFrame([(1, list("abc"))], "query_id int, tags array<string>")
    c = spark.createDataFrame([(1, list("abcd")), (2, list("ab")), (3, [])], "doc_id int, tags array<string>")
    got = [(r.id, r.score) for r in sequences.rank_sequences(q, c, "tags", -1).orderBy("rank").collect()]
    assert got == [(1, 0.75), (2, pytest.approx(2 / 3)), (3, 0.0)]


def test_phonemic_diversity_counts_characters(spark):
    texts = ["ab", "ab", "zz"]
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "g string, doc_id int, text string")
    strings = ["a b", "a b", "z z"]
    want = dense_hill(sequence_matrix([list(s) for s in strings]))
    assert phonology.phonemic_diversity(df, ["g"]).first().diversity == pytest.approx(want)
    assert list(itertools.chain(strings[0])) == ["a", " ", "b"]
