"""Text columns: tokens, n-grams, cleaning, splitting, word-shape statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, digits and underscore of every script. Java's bare \w
# is ASCII only and would cut accented words apart.
WORD = r"[\p{L}\p{N}_]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside a lambda, where
    Spark does not share equal subexpressions."""
    return F.transform(F.array(value), body)[0]


def non_blank(text: str | Column) -> Column:
    """True where the text is present and holds more than whitespace."""
    c = _col(text)
    return c.isNotNull() & F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def tokens(text: str | Column, lowercase: bool = True) -> Column:
    """Word tokens in order, as ``ARRAY<STRING>``."""
    c = _col(text)
    return F.regexp_extract_all(F.lower(c) if lowercase else c, F.lit(WORD), F.lit(0))


def ngrams(toks: Column, n: int) -> Column:
    """Contiguous n-grams of a token array, words joined by a blank.

    Tokens hold no blanks, so the joined string identifies the n-gram. Shorter
    arrays give an empty array.
    """
    if n == 1:
        return toks
    length = F.greatest(F.size(toks) - F.lit(n - 1), F.lit(0))
    # Shifted slices are zipped, so the token array is evaluated a fixed number of
    # times per row. Inside a lambda it would be evaluated again for every element.
    grams = F.slice(toks, F.lit(1), length)
    for k in range(1, n):
        grams = F.zip_with(
            grams, F.slice(toks, F.lit(k + 1), length), lambda a, b: F.concat_ws(" ", a, b)
        )
    return grams


def words(text: str | Column) -> Column:
    """Whitespace-separated words, empty strings removed."""
    return F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != "")


def clean_text(text: str | Column) -> Column:
    """Line-break tags to blanks, runs of full stops to one, a blank after
    sentence marks, whitespace collapsed."""
    c = F.regexp_replace(_col(text), r"<br\s*/?>", " ")
    c = F.regexp_replace(c, r"\.{2,}", ". ")
    c = F.regexp_replace(c, r"([.!?])", "$1 ")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def _trimmed(parts: Column) -> Column:
    stripped = F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda s: s != "")


def sentences(text: str | Column) -> Column:
    """Sentences that keep their closing mark: cut after ``. ! ?`` plus blanks."""
    return _trimmed(F.split(_col(text), r"(?U)(?<=[.!?])\s+"))


def clauses(text: str | Column) -> Column:
    """Sentences without their marks: cut at every run of ``. ! ?``."""
    return _trimmed(F.split(_col(text), r"[.!?]+"))


def strip_punctuation(text: str | Column) -> Column:
    """Delete the 32 ASCII punctuation characters."""
    return F.translate(_col(text), PUNCTUATION, "")


def word_chunks(text: str | Column) -> Column:
    """Consecutive chunks of ``max(3, words // 3)`` words, each joined by blanks."""

    def cut(w: Column) -> Column:
        step = F.greatest(F.lit(3), F.floor(F.size(w) / 3).cast("int"))
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), step),
            lambda i: F.array_join(F.slice(w, i + 1, step), " "),
        )

    return F.filter(let(words(text), cut), lambda chunk: chunk != "")


def word_shape(word: Column) -> Column:
    """UPPER, Title, lower or mixed, by the case of the word's letters."""
    first = F.substring(word, 1, 1)
    upper = (word == F.upper(word)) & (word != F.lower(word))
    title = (first == F.upper(first)) & (first != F.lower(first))
    lower = (word == F.lower(word)) & (word != F.upper(word))
    return F.when(upper, "UPPER").when(title, "Title").when(lower, "lower").otherwise("mixed")


def shape_tags(text: str | Column) -> Column:
    """Word shapes of a text in order."""
    return F.transform(words(text), word_shape)


def shape_variety(text: str | Column) -> Column:
    """Number of distinct word shapes over four."""
    shapes = F.transform(F.array_distinct(words(text)), word_shape)
    return F.size(F.array_distinct(shapes)) / F.lit(4.0)


def vowel_variety(text: str | Column) -> Column:
    """Number of distinct vowel counts per word (counted up to five) over five."""
    counts = F.transform(
        F.array_distinct(words(text)), lambda w: F.least(F.regexp_count(w, F.lit("[aeiouAEIOU]")), F.lit(5))
    )
    return F.size(F.array_distinct(counts)) / F.lit(5.0)


def unique_word_ratio(text: str | Column) -> Column:
    """Distinct words over words, case kept; zero for an empty text."""
    ratio = let(words(text), lambda w: F.try_divide(F.size(F.array_distinct(w)), F.size(w)))
    return F.coalesce(ratio, F.lit(0.0))


def length_proxy(text: str | Column) -> Column:
    """Words over twenty, at most one."""
    return F.least(F.lit(1.0), F.size(words(text)) / F.lit(20.0))
