"""The pipeline as a whole on odd and on empty tables."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d int, __llm_kept string, seg string"


def write(spark, folder, rows, labels):
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


LINE = "a line of more than twenty characters"
ROWS = [
    (1, None, "en", None, None),
    (2, "", None, "a", 0),
    (3, "word " * 30_000 + "x" * 5_000, "en", "a", 1),
    (4, "word " * 30_000 + "x" * 5_000, "en", "a", 1),
    (4, "word " * 30_000 + "x" * 5_000, "en", "a", 1),
    (None, "some text without an id at all", "de", "b", 3),
    (None, "another text without an id, not like it", "de", "b", 3),
    (6, "\n\n  \n", "de", "b", 3),
    (7, f"{LINE}\none", "fr", "b", 3),
    (8, f"{LINE}\ntwo", "fr", "b", 3),
    (9, f"{LINE}\nthree", "fr", "b", 3),
]


@pytest.mark.parametrize("labels", [[], [(7, 1, 1)], [(7, 1, 0), (8, 1, None), (None, 1, 1)]])
def test_odd_rows_keep_what_is_clean(spark, tmp_path, labels):
    write(spark, tmp_path, ROWS, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-2]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.dtypes == docs.dtypes, name
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    # Copies of 3 go, and nothing else: labels of one kind reject nobody.
    assert ids == [(False, 1), (False, 2), (False, 3), (False, 6), (False, 7), (False, 8), (False, 9), (True, 0), (True, 0)]
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[7] == "one" and texts[8] == "two" and texts[9] == f"{LINE}\nthree"
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {r[0] for r in ROWS} and len(out) >= 3


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
