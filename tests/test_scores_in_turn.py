"""Several metrics are worked out one after the other; spellings are hashed after tokens are moved."""

from effnum.operators import encode, tokens
from effnum.plans import metrics, profiles

ROWS = [(1, 1, "Ab cd. Ef gh"), (1, 2, "cd ef, gh ij"), (2, 1, "one two"), (2, 2, "two three four")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_of_several_metrics_are_written(spark):
    corpus = spark.createDataFrame(ROWS, "n int, doc_id int, text string")
    some = {k: v for k, v in metrics.text_metrics().items() if k in ("document_semantics", "rhythmic")}
    scores = profiles.compute_scores(corpus, ["n"], some)
    assert "Exchange" not in _plan(scores)
    one = [profiles.compute_scores(corpus, ["n"], {k: v}) for k, v in some.items()]
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, one[0].unionByName(one[1]).collect()))


def test_hashing_after_the_move_gives_the_same(spark):
    rows = [(1, 1, 0, "play"), (1, 1, 1, "##ing"), (1, 2, 0, "go"), (2, 1, 0, "cat"), (2, 1, 1, "sat"), (3, 1, 0, "")]
    table = spark.createDataFrame(rows, "n int, doc_id int, pos int, token string")

    def embed(t):
        return encode.hashed_spelling(t, dim=8)

    late = tokens.token_diversity(table, ["n"], embed=embed, mean_adjust=False)
    early = tokens.token_diversity(embed(table), ["n"], mean_adjust=False)
    assert sorted(map(str, late.collect())) == sorted(map(str, early.collect()))
    moved = tokens.merge_subwords(table, ["n"], embed=embed)
    assert sorted(r.word for r in moved.collect()) == ["", "cat", "go", "playing", "sat"]
