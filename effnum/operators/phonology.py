"""Sound features of texts: rhythm codes, phonemes, part-of-speech tags.

Dictionary knowledge comes as a lexicon table ``word, phones ARRAY<STRING>,
syllables ARRAY<STRING>, pos``. Words are looked up by an ordinary join, so Spark
broadcasts a small lexicon and shuffles a large one. Without a lexicon the same
features follow from the spelling alone and stay a projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sound as so
from ..functions import text as tx
from ..session import keyed, unkeyed
from .sequences import sequence_diversity

NO_RHYTHM = ""


def _syllable_records(syllables: Column, stress: Column) -> Column:
    """``ARRAY<STRUCT<syllable, stress, weight>>``; stress missing at the end is 0."""
    return F.transform(
        syllables,
        lambda s, i: F.struct(
            s.alias("syllable"),
            F.coalesce(F.get(stress, i), F.lit(0)).alias("stress"),
            so.syllable_weight(s).alias("weight"),
        ),
    )


def _spelled(word: Column) -> Column:
    """Syllable records of a word from its spelling."""
    return tx.let(
        so.syllables(word),
        lambda parts: tx.let(
            so.default_stress(F.size(parts)), lambda stress: _syllable_records(parts, stress)
        ),
    )


def _words_of(text: Column) -> Column:
    return so.ascii_words(text)


def analyze(
    df: DataFrame, id: str | Sequence[str] = "doc_id", text: str = "text", lexicon: DataFrame | None = None
) -> DataFrame:
    """``id..., analysis``: per word the word and its syllables with stress and weight."""
    ids = [id] if isinstance(id, str) else list(id)
    if lexicon is None:
        records = F.transform(
            _words_of(F.col(text)), lambda w: F.struct(w.alias("word"), _spelled(w).alias("syllables"))
        )
        return df.select(*ids, records.alias("analysis"))
    words = df.select(*ids, F.posexplode_outer(_words_of(F.col(text))).alias("_i", "word"))
    entries = lexicon.select("word", F.col("phones").alias("_ph"), F.col("syllables").alias("_sy"))
    found = words.join(entries, "word", "left")
    syllables = F.coalesce(F.col("_sy"), so.syllables(F.col("word")))
    stress = F.when(F.col("_ph").isNotNull(), so.phone_stress(F.col("_ph"))).otherwise(
        so.default_stress(F.size(syllables))
    )
    record = F.struct("word", _syllable_records(syllables, stress).alias("syllables"))
    rows = found.withColumn("_r", F.when(F.col("word").isNotNull(), F.struct("_i", record.alias("r"))))
    # collect_list leaves out the null of a document without words.
    ordered = F.array_sort(F.collect_list("_r"))
    return rows.groupBy(*ids).agg(F.transform(ordered, lambda e: e["r"]).alias("analysis"))


def rhythm_codes(
    df: DataFrame,
    id: str | Sequence[str] = "doc_id",
    text: str = "text",
    lexicon: DataFrame | None = None,
    clean: bool = True,
    out: str = "rhythm",
) -> DataFrame:
    """``id..., rhythm``: per word the stress and weight of its first syllable, as
    two binary digits. A text without words gets a single empty code, which matches
    other empty codes."""
    ids = [id] if isinstance(id, str) else list(id)
    prepared = tx.strip_punctuation(tx.clean_text(text)) if clean else F.col(text)
    if lexicon is None:

        def spelled(word: Column) -> Column:
            weight = so.syllable_weight(so.first_syllable(word))
            return F.concat(so.first_stress(word).cast("string"), weight.cast("string"))

        codes = F.transform(_words_of(prepared), spelled)
    else:

        def looked_up(word: Column) -> Column:
            first = word["syllables"][0]
            return F.concat((first["stress"] > 0).cast("int").cast("string"), first["weight"].cast("string"))

        df = analyze(df.select(*ids, prepared.alias("_t")), ids, "_t", lexicon)
        codes = F.transform(F.filter("analysis", lambda w: F.size(w["syllables"]) > 0), looked_up)
    filled = tx.let(codes, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(NO_RHYTHM))))
    return df.select(*ids, filled.alias(out))


def phonemes(
    df: DataFrame,
    id: str | Sequence[str] = "doc_id",
    text: str = "text",
    lexicon: DataFrame | None = None,
    unknown: str = "spell",
    out: str = "phonemes",
) -> DataFrame:
    """``id..., phonemes``: the phones of a text joined by blanks.

    Words not in the lexicon are spelled letter by letter, or dropped with
    ``unknown="drop"``. A word that cannot be resolved never affects other rows.
    """
    if unknown not in ("spell", "drop"):
        raise ValueError(f"unknown policy {unknown!r}, expected 'spell' or 'drop'")
    ids = [id] if isinstance(id, str) else list(id)
    toks = tx.tokens(tx.clean_text(text))

    def letters(word: Column) -> Column:
        return F.filter(F.split(word, ""), lambda c: c != "")

    if lexicon is None:
        phones = F.flatten(F.transform(toks, letters)) if unknown == "spell" else F.array().cast("array<string>")
        return df.select(*ids, F.array_join(phones, " ").alias(out))
    words = df.select(*ids, F.posexplode_outer(toks).alias("_i", "word"))
    found = words.join(lexicon.select("word", F.col("phones").alias("_ph")), "word", "left")
    fallback = letters(F.col("word")) if unknown == "spell" else F.array().cast("array<string>")
    rows = found.withColumn(
        "_r", F.when(F.col("word").isNotNull(), F.struct("_i", F.coalesce("_ph", fallback).alias("p")))
    )
    ordered = F.array_sort(F.collect_list("_r"))
    phones = F.flatten(F.transform(ordered, lambda e: e["p"]))
    return rows.groupBy(*ids).agg(F.array_join(phones, " ").alias(out))


def pos_tags(
    df: DataFrame,
    id: str | Sequence[str],
    text: str,
    lexicon: DataFrame,
    unknown: str = "X",
    out: str = "tags",
) -> DataFrame:
    """``id..., tags``: the lexicon's tag of every word, ``unknown`` where it has none."""
    ids = [id] if isinstance(id, str) else list(id)
    words = df.select(*ids, F.posexplode_outer(tx.tokens(tx.clean_text(text))).alias("_i", "word"))
    found = words.join(lexicon.select("word", F.col("pos").alias("_pos")), "word", "left")
    row = F.when(F.col("word").isNotNull(), F.struct("_i", F.coalesce("_pos", F.lit(unknown)).alias("t")))
    ordered = F.array_sort(F.collect_list(row))
    return found.groupBy(*ids).agg(F.transform(ordered, lambda e: e["t"]).alias(out))


def as_sentences(df: DataFrame, by: Sequence[str], id: str, text: str) -> DataFrame:
    """One row per sentence of the cleaned text, the id as ``(id, sentence number)``."""
    parts = df.select(*by, id, F.posexplode(tx.sentences(tx.clean_text(text))).alias("_s", text))
    return parts.select(*by, F.struct(id, "_s").alias(id), text)


def rhythmic_diversity(
    df: DataFrame,
    by: Sequence[str] = (),
    id: str = "doc_id",
    text: str = "text",
    lexicon: DataFrame | None = None,
    split_sentences: bool = False,
    pad: bool = False,
    **options: object,
) -> DataFrame:
    """Diversity of rhythm codes, one species per document or sentence."""
    src, keys = keyed(df, by)
    if split_sentences:
        src = as_sentences(src, keys, id, text)
    codes = rhythm_codes(src, [*keys, id], text, lexicon)
    flagged = _with_validity(codes, src, keys, id, text)
    options.setdefault("metric_name", "rhythmic")
    return unkeyed(
        by,
        sequence_diversity(flagged, keys, "rhythm", pad="N" if pad else None, valid=F.col("valid"), **options)
    )


def phonemic_diversity(
    df: DataFrame,
    by: Sequence[str] = (),
    id: str = "doc_id",
    text: str = "text",
    lexicon: DataFrame | None = None,
    unknown: str = "spell",
    split_sentences: bool = False,
    pad: bool = False,
    **options: object,
) -> DataFrame:
    """Diversity of phoneme strings, compared character by character."""
    src, keys = keyed(df, by)
    if split_sentences:
        src = as_sentences(src, keys, id, text)
    strings = phonemes(src, [*keys, id], text, lexicon, unknown)
    chars = F.filter(F.split("phonemes", ""), lambda c: c != "")
    flagged = _with_validity(strings, src, keys, id, text).withColumn("phonemes", chars)
    options.setdefault("metric_name", "phonemic")
    return unkeyed(
        by,
        sequence_diversity(flagged, keys, "phonemes", pad=" " if pad else None, valid=F.col("valid"), **options)
    )


def _with_validity(features: DataFrame, src: DataFrame, keys: list[str], id: str, text: str) -> DataFrame:
    """Attach whether the group's texts are all usable; one flag row per group."""
    flags = src.groupBy(*keys).agg(F.min(tx.non_blank(text)).alias("valid"))
    return features.join(flags, keys)
