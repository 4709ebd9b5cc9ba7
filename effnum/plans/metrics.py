"""The seven metrics as functions of a text corpus, for profiles and estimation.

Each takes ``corpus(by..., doc_id, text)`` and the keys and gives ``by...,
diversity`` (and status columns). Vectors and parses normally come from outside;
these defaults derive them from the text so that every metric can be computed from
text alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import encode, lexical, phonology, sequences, tokens, trees, vectors
from .profiles import Metric

Embed = Callable[[DataFrame], DataFrame]


def document_semantics(embed: Embed | None = None, dim: int = 64, **options: object) -> Metric:
    """Documents as hashed word counts, or whatever ``embed`` adds as ``vec``."""

    def metric(corpus: DataFrame, by: list[str]) -> DataFrame:
        vec = embed(corpus) if embed else encode.hashed_words(corpus, dim=dim)
        return vectors.document_diversity(vec, by, "doc_id", "vec", text="text", dim=dim, **options)

    return metric


def token_semantics(embed: Embed | None = None, dim: int = 64, **options: object) -> Metric:
    """Tokens as hashed spellings, or whatever ``embed`` adds as ``vec``."""

    def metric(corpus: DataFrame, by: list[str]) -> DataFrame:
        table = encode.token_table(corpus, by)
        if embed:
            return tokens.token_diversity(embed(table), by, dim=dim, **options)
        # Spellings are hashed after the tokens are moved, not before.
        return tokens.token_diversity(table, by, dim=dim, embed=lambda t: encode.hashed_spelling(t, dim=dim), **options)

    return metric


def pos_sequence(
    lexicon: DataFrame | None = None, split_sentences: bool = False, **options: object
) -> Metric:
    """Tags from a lexicon, or word shapes without one; one species per text, or per sentence."""

    def metric(corpus: DataFrame, by: list[str]) -> DataFrame:
        if split_sentences:
            corpus = phonology.as_sentences(corpus, by, "doc_id", "text")
        if lexicon is None:
            tagged = corpus.select(*by, "doc_id", tx.shape_tags("text").alias("tags"))
        else:
            tagged = phonology.pos_tags(corpus, [*by, "doc_id"], "text", lexicon)
        return sequences.sequence_diversity(tagged, by, "tags", **options)

    return metric


def rhythmic(lexicon: DataFrame | None = None, **options: object) -> Metric:
    return lambda corpus, by: phonology.rhythmic_diversity(corpus, by, lexicon=lexicon, **options)


def phonemic(lexicon: DataFrame | None = None, **options: object) -> Metric:
    return lambda corpus, by: phonology.phonemic_diversity(corpus, by, lexicon=lexicon, **options)


def _clauses(text: str) -> Column:
    """The words of every clause of a whole text: cut at sentence ends and at ``, ; :``."""
    parts = F.flatten(F.transform(tx.sentences(tx.clean_text(text)), lambda s: F.split(s, "[,;:]")))
    return F.filter(F.transform(parts, tx.words), lambda w: F.size(w) > 0)


# Clause k starts at node number k * CLAUSE (a BIGINT), so no clause runs into the next one.
CLAUSE = 1 << 32


def chunk_trees(
    corpus: DataFrame, by: list[str], id: str = "doc_id", text: str = "text", split_sentences: bool = False
) -> DataFrame:
    """``by..., id, node, parent, label``: a shallow phrase tree of each whole text, or
    of each of its sentences: the text, its clauses, their word shapes. A text without
    words is a lone root; a null text as well, unless sentences are split."""
    if split_sentences:
        corpus = phonology.as_sentences(corpus, by, id, text)
    nested = F.transform(
        F.coalesce(_clauses(text), F.array().cast("array<array<string>>")),
        lambda words, k: F.concat(
            F.array(F.struct(((k + 1) * CLAUSE).alias("node"), F.lit(0).cast("bigint").alias("parent"), F.lit("CL").alias("label"))),
            F.transform(
                words,
                lambda w, i: F.struct(
                    ((k + 1) * CLAUSE + i + 1).alias("node"),
                    ((k + 1) * CLAUSE).alias("parent"),
                    tx.word_shape(w).alias("label"),
                ),
            ),
        ),
    )
    nothing = F.lit(None).cast("bigint")
    root = F.array(F.struct(F.lit(0).cast("bigint").alias("node"), nothing.alias("parent"), F.lit("S").alias("label")))
    rows = corpus.select(*by, id, F.explode(F.concat(root, F.flatten(nested))).alias("_n"))
    return rows.select(*by, id, "_n.node", "_n.parent", "_n.label")


def constituency_parse(
    parse: Embed | None = None, split_sentences: bool = False, **options: object
) -> Metric:
    """Phrase trees from ``parse``, or shallow chunk trees without one; one species per
    text, or per sentence. A given parser gets the sentences as rows of their own."""

    def metric(corpus: DataFrame, by: list[str]) -> DataFrame:
        texts = phonology.as_sentences(corpus, by, "doc_id", "text") if split_sentences else corpus
        edges = parse(texts) if parse else chunk_trees(texts, by)
        return trees.constituency_diversity(edges, by, **options)

    return metric


def dependency_parse(
    parse: Embed | None = None, split_sentences: bool = False, **options: object
) -> Metric:
    """Dependency parses from ``parse``; without one every word depends on the first
    word of its clause and clauses on the first clause. One species per text, or per
    sentence; a given parser gets the sentences as rows of their own."""

    def metric(corpus: DataFrame, by: list[str]) -> DataFrame:
        texts = phonology.as_sentences(corpus, by, "doc_id", "text") if split_sentences else corpus
        edges = parse(texts) if parse else head_first_parses(texts, by)
        return trees.dependency_diversity(edges, by, **options)

    return metric


def head_first_parses(
    corpus: DataFrame, by: list[str], id: str = "doc_id", text: str = "text", split_sentences: bool = False
) -> DataFrame:
    """``by..., id, tok, head, pos, dep`` of each whole text, or of each of its sentences.
    Texts without words have no rows."""
    if split_sentences:
        corpus = phonology.as_sentences(corpus, by, id, text)
    nested = F.transform(
        _clauses(text),
        lambda words, k: F.transform(
            words,
            lambda w, i: F.struct(
                (k * CLAUSE + i).alias("tok"),
                F.when(i > 0, k * CLAUSE).otherwise(F.lit(0).cast("bigint")).alias("head"),
                tx.word_shape(w).alias("pos"),
                F.when(i > 0, F.lit("dep")).otherwise(F.lit("conj")).alias("dep"),
            ),
        ),
    )
    rows = corpus.select(*by, id, F.explode(F.flatten(nested)).alias("_n"))
    return rows.select(*by, id, "_n.tok", "_n.head", "_n.pos", "_n.dep")


def type_token_ratio(**options: object) -> Metric:
    def metric(corpus: DataFrame, by: list[str]) -> DataFrame:
        return lexical.type_token_ratio(corpus, by, **options).withColumnRenamed("value", "diversity")

    return metric


def distinct_n(n: int = 2, **options: object) -> Metric:
    def metric(corpus: DataFrame, by: list[str]) -> DataFrame:
        return lexical.distinct_n(corpus, by, n=n, **options).withColumnRenamed("value", "diversity")

    return metric


def self_bleu(**options: object) -> Metric:
    def metric(corpus: DataFrame, by: list[str]) -> DataFrame:
        return lexical.self_bleu(corpus, by, **options).withColumnRenamed("value", "diversity")

    return metric


def text_metrics(lexicon: DataFrame | None = None, mean_adjust: bool = True) -> dict[str, Metric]:
    """All seven metrics from text alone."""
    return {
        "token_semantics": token_semantics(mean_adjust=mean_adjust),
        "document_semantics": document_semantics(),
        "dependency_parse": dependency_parse(),
        "constituency_parse": constituency_parse(),
        "pos_sequence": pos_sequence(lexicon),
        "rhythmic": rhythmic(lexicon),
        "phonemic": phonemic(lexicon),
    }
