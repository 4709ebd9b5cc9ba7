"""Seven-dimensional profile vectors of corpora, documents and windows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ordinals import ordinal
from ..session import cut_lineage, keyed, unkeyed
from .config import PROFILE_METRICS, PROFILE_SCALE

# A metric takes a corpus (by..., doc_id, text) and the keys, and gives by..., diversity.
Metric = Callable[[DataFrame, list[str]], DataFrame]

# Which stand-in a metric uses for a document that cannot be split.
SEMANTIC = ("token_semantics", "document_semantics")
SYNTACTIC = ("dependency_parse", "constituency_parse")
SHAPES = ("pos_sequence",)
# Fixed value: score of a structural metric that failed on a document.
FAILED = 0.5


def normalize(profile: Column) -> Column:
    """``log1p`` of each position over its scale, clipped to [0, 1]."""
    scale = F.array(*[F.lit(s) for s in PROFILE_SCALE])
    return F.zip_with(
        profile,
        scale,
        lambda x, s: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log1p(F.greatest(x, F.lit(0.0))) / s)),
    )


def normalize_matrix(df: DataFrame, vec: str = "profile") -> DataFrame:
    """Normalise a ready column of raw profiles; a row of another length is an error."""
    size = len(PROFILE_METRICS)
    message = F.lit(f"a profile must have {size} positions")
    checked = F.when(F.size(vec) == size, F.col(vec).cast("array<double>")).otherwise(F.raise_error(message))
    return df.withColumn(vec, normalize(checked))


def assemble(scores: DataFrame, by: Sequence[str] = (), normalized: bool = True) -> DataFrame:
    """``by..., profile`` from long scores; unknown metrics are ignored, missing are 0."""
    src, keys = keyed(scores, by)
    per_metric = [
        F.coalesce(F.max(F.when(F.col("metric") == m, F.col("score").cast("double"))), F.lit(0.0)).alias(m)
        for m in PROFILE_METRICS
    ]
    wide = src.groupBy(*keys).agg(*per_metric)
    profile = F.array(*[F.col(m) for m in PROFILE_METRICS])
    return unkeyed(by, wide.select(*keys, (normalize(profile) if normalized else profile).alias("profile")))


def _in_turn(scores: DataFrame, metrics: Mapping[str, Metric]) -> DataFrame:
    """The scores of one of several metrics, worked out now and written: one plan of all of them would be
    held, and planned anew after each of its stages, in the driver's memory."""
    return cut_lineage(scores) if len(metrics) > 1 else scores


def compute_scores(
    corpus: DataFrame,
    by: Sequence[str],
    metrics: Mapping[str, Metric],
    precomputed: DataFrame | None = None,
) -> DataFrame:
    """``by..., metric, score``: given scores as they are, the others computed.

    Groups whose score of a metric is given are left out of that metric's input by
    an anti-join, so their texts are never touched for it.
    """
    keys = list(by)
    parts = []
    for name, metric in metrics.items():
        todo = corpus
        if precomputed is not None and keys:
            known = precomputed.where(F.col("metric") == name).select(*keys).distinct()
            todo = corpus.join(known, keys, "left_anti")
        found = metric(todo, keys)
        scored = found.select(*keys, F.lit(name).alias("metric"), F.col("diversity").alias("score"))
        parts.append(_in_turn(scored, metrics))
    if precomputed is not None:
        parts.append(precomputed.select(*keys, "metric", F.col("score").cast("double").alias("score")))
    return reduce(DataFrame.unionByName, parts)


def corpus_profile(
    corpus: DataFrame,
    by: Sequence[str],
    metrics: Mapping[str, Metric],
    precomputed: DataFrame | None = None,
    normalized: bool = True,
) -> DataFrame:
    """One profile per group, computing only what is not given."""
    return assemble(compute_scores(corpus, by, metrics, precomputed), by, normalized)


def _family(name: str) -> tuple[Column, Column, Column]:
    """Parts a document is cut into, its score when it has fewer than two, and its
    score when the metric fails."""
    text = F.col("text")
    some_words = F.size(tx.words(text)) > 0
    if name in SEMANTIC:
        few = F.when(F.size(tx.words(text)) < 2, F.lit(0.0)).otherwise(tx.unique_word_ratio(text))
        return tx.word_chunks(text), few, tx.unique_word_ratio(text)
    if name in SYNTACTIC:
        return tx.clauses(text), tx.length_proxy(text), F.lit(FAILED)
    proxy = tx.shape_variety(text) if name in SHAPES else tx.vowel_variety(text)
    return tx.clauses(text), F.when(some_words, proxy).otherwise(F.lit(0.0)), F.lit(FAILED)


def richness(corpus: DataFrame, metrics: Mapping[str, Metric]) -> DataFrame:
    """``doc_id, metric, score``: the diversity inside each document.

    A document becomes a corpus of its own parts, keyed by the document, so the
    grouped metrics apply unchanged. Blank documents give no row.
    """
    docs = corpus.where(tx.non_blank("text")).select("doc_id", "text")
    out = []
    for name, metric in metrics.items():
        parts, few, failed = _family(name)
        cut = docs.select("doc_id", "text", parts.alias("_parts"))
        splittable = F.size("_parts") >= 2
        if name in SEMANTIC:
            # Below two words there is nothing to compare, however it is cut.
            splittable = splittable & (F.size(tx.words("text")) >= 2)
        short = cut.where(~splittable).select("doc_id", few.alias("score"))
        pieces = cut.where(splittable).select(
            F.col("doc_id").alias("_doc"), F.posexplode("_parts").alias("doc_id", "text")
        )
        measured = metric(pieces, ["_doc"]).select(F.col("_doc").alias("doc_id"), "diversity")
        # A document the metric has no answer for keeps the stand-in of its family.
        whole = (
            cut.where(splittable)
            .select("doc_id", failed.alias("_failed"))
            .join(measured, "doc_id", "left")
            .select("doc_id", F.coalesce("diversity", "_failed").alias("score"))
        )
        both = short.unionByName(whole)
        out.append(both.select("doc_id", F.lit(name).alias("metric"), "score"))
    return reduce(DataFrame.unionByName, out)


def document_profiles(
    corpus: DataFrame,
    metrics: Mapping[str, Metric],
    window: int = 1,
    stride: int = 1,
    order_by: str | None = None,
    normalized: bool = True,
    precomputed: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, profile`` for every document of ``corpus(doc_id, text)``.

    ``window=1`` measures each document by itself, using the scores in
    ``precomputed(doc_id, metric, score)`` where they exist. A larger window
    measures the corpus of neighbouring documents in the order of ``order_by``;
    given scores play no part there.
    """
    if window > 1:
        if order_by is None:
            raise ValueError("windows need order_by")
        return windowed_profiles(corpus, [], metrics, window, stride, order_by, normalized)
    parts = []
    for name, metric in metrics.items():
        todo = corpus
        if precomputed is not None:
            known = precomputed.where(F.col("metric") == name).select("doc_id").distinct()
            todo = corpus.join(known, "doc_id", "left_anti")
        parts.append(_in_turn(richness(todo, {name: metric}), metrics))
    if precomputed is not None:
        blank = corpus.where(~tx.non_blank("text")).select("doc_id")
        given = precomputed.join(blank, "doc_id", "left_anti")
        parts.append(given.select("doc_id", "metric", F.col("score").cast("double").alias("score")))
    scores = reduce(DataFrame.unionByName, parts)
    # Every document has a row, blank ones all zeros.
    nothing = corpus.select("doc_id", F.lit("").alias("metric"), F.lit(0.0).alias("score"))
    return assemble(scores.unionByName(nothing), ["doc_id"], normalized)


def windowed_profiles(
    corpus: DataFrame,
    by: Sequence[str],
    metrics: Mapping[str, Metric],
    window: int,
    stride: int,
    order_by: str,
    normalized: bool = True,
) -> DataFrame:
    """``by..., doc_id, profile``: each document has the profile of its window.

    Windows start at every multiple of ``stride``; of the windows over a document
    the last one counts, which starts at its position rounded down to a multiple of
    ``stride``. A document that lies in no window gets zeros. Only windows that are
    some document's last are measured.
    """
    if window < 1 or stride < 1:
        raise ValueError("window and stride must be at least 1")
    src, keys = keyed(corpus, by)
    placed = ordinal(src.select(*keys, "doc_id", "text", order_by), keys, [order_by, "doc_id"], "_pos")
    owner = F.floor(F.col("_pos") / stride) * stride
    home = placed.select(*keys, "doc_id", owner.alias("_start"), (F.col("_pos") - owner < window).alias("_in"))
    # The starts of all windows over a document, newest first.
    back = F.sequence(F.lit(0), F.lit((window - 1) // stride))
    starts = F.filter(
        F.transform(back, lambda k: owner - k * stride),
        lambda s: (s >= 0) & (F.col("_pos") - s < window),
    )
    members = placed.select(*keys, F.explode(starts).alias("_start"), "doc_id", "text")
    profiles = assemble(compute_scores(members, [*keys, "_start"], metrics), [*keys, "_start"], normalized)
    out = home.join(profiles, [*keys, "_start"], "left")
    zeros = F.array(*[F.lit(0.0)] * len(PROFILE_METRICS))
    value = F.when(F.col("_in"), F.coalesce("profile", zeros)).otherwise(zeros)
    return unkeyed(by, out.select(*keys, "doc_id", value.alias("profile")))
