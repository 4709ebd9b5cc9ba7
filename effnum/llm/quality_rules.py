"""Quality rules as a ledger of failure bits, with versioned policies and ablations on top.

Every text is measured once. Every rule is a condition on the measurements and owns one
bit; a row's ledger entry is its measurements and the bits of the rules it fails. The
ledger is a narrow table (no text) that can be stored. A policy is a version name with
a mask of rules that reject at once and a mask of weak signs that reject together; it
is applied to the stored bits, so a new version needs no text and no new measurement.
Ablations come from the bits too: equal bit patterns are counted first (partial
aggregation, at most two to the number of rules per group), and what a rule rejects,
rejects alone or shares with another one follows from the patterns by bit operations.

Words and windows are compared as they are, not as hashes. Memory grows with the
distinct words of one text and eight bytes for each of its words.

Defined cases: a null text is a text without words (all measurements 0, rejected for
having too few words, like the empty text); every row is an entry of its own, so rows
that are repeated or share an id, or have none, stay; long texts are measured whole; an
empty table gives an empty ledger; other columns of the input, whatever their names, are
ignored by ``ledger`` and kept by ``filtered``.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

WINDOW = 5  # words of a window that may repeat
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
PIECE = 1 << 20  # bytes split into words at a time
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` maps a function from measure names to columns to a condition; its place in RULES is its bit."""

    name: str
    fails: object


RULES = (
    Rule("few_words", lambda m: m("n_words") < 10),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
    Rule("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 20 * m("n_words")),
    Rule("some_symbols", lambda m: 25 * m("n_symbols") > m("n_words")),
    Rule("some_repeated_lines", lambda m: 100 * m("n_dup_lines") > 15 * m("n_lines")),
    Rule("some_repeated_windows", lambda m: 100 * m("n_repeat_words") > 10 * m("n_words")),
    Rule("echoes", lambda m: 100 * m("n_echo_words") > 30 * m("n_words")),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in set(names))


@dataclass(frozen=True)
class Policy:
    """A row is rejected if it fails a rule of ``hard``, or at least ``limit`` rules of ``weak``."""

    version: str
    hard: int
    weak: int = 0
    limit: int = 1


BASE = Policy("base", mask("few_words", "repeated_windows"))
POLICIES = {
    p.version: p
    for p in (
        BASE,
        Policy("1", BASE.hard | mask("symbols", "repeated_lines")),
        # Lines that a text repeats count as one sign only: passages of clean texts may repeat too.
        Policy(
            "2",
            BASE.hard | mask("symbols", "short_words", "long_words", "echoes"),
            mask("some_symbols", "some_repeated_lines", "some_repeated_windows"),
            3,
        ),
    )
}
CURRENT = "2"


def word_codes(data: bytes) -> np.ndarray:
    """The words of a text (UTF-8; white space is ASCII) as numbers, equal words with equal numbers from 0."""
    codes: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    parts, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = data[at:end].split()
        parts.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def window_codes(word: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """A number for each window of ``width`` words; equal windows, and no others, have equal numbers."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    distinct = int(word.max()) + 1
    code, size = word[:n], distinct
    for j in range(1, width):
        if size * distinct >= 1 << 62:  # number the windows so far anew
            code = np.unique(code, return_inverse=True)[1]
            size = int(code.max()) + 1
        code = code * distinct + word[j : n + j]
        size *= distinct
    return code


def repeated_words(word: np.ndarray, width: int = WINDOW) -> int:
    """How many words lie in a window that the text holds twice or more."""
    code = window_codes(word, width)
    order = np.argsort(code, kind="stable")
    same = np.zeros(len(code) + 1, bool)
    same[1:-1] = code[order[1:]] == code[order[:-1]]
    twice = order[same[:-1] | same[1:]] if len(code) else order
    if not len(twice):
        return 0
    inside = np.zeros(len(word), bool)
    for j in range(width):
        inside[twice + j] = True
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The numbers named in MEASURES; an echo word equals the word before it."""
    text = text or ""
    word = word_codes(text.encode())
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(word),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(word),
        int((word[1:] == word[:-1]).sum()),
    )


@F.arrow_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def measured(texts: pa.Array) -> pa.Array:
    rows = np.array([measure(t.as_py()) for t in texts], np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], list(MEASURES))


def failure_bits(m, rules: Sequence[Rule] = RULES) -> Column:
    """The bits of the rules that fail; ``m`` gives the column of a measure."""
    bits = [F.when(r.fails(m), F.lit(1 << i)).otherwise(0).cast("long") for i, r in enumerate(rules)]
    return sum(bits[1:], bits[0])


def ledger(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``keys``, the measurements and ``bits`` of every row."""
    rows = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], measured(F.col(text)).alias("_m"))
    own = rows.withColumn("bits", failure_bits(lambda name: F.col("_m")[name], rules))
    return own.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[F.col("_m")[m].alias(m) for m in MEASURES], "bits")


def passes(bits: str | Column, policy: Policy) -> Column:
    """Whether a row with these failure bits is kept."""
    b = F.col(bits) if isinstance(bits, str) else bits
    kept = b.bitwiseAND(policy.hard) == 0
    if policy.weak:
        kept = kept & (F.bit_count(b.bitwiseAND(policy.weak)) < policy.limit)
    return kept


def filtered(docs: DataFrame, policy: Policy = POLICIES[CURRENT], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns."""
    marked = docs.withColumn("__llm_m", measured(F.col(text)))
    return marked.where(passes(failure_bits(lambda name: F.col("__llm_m")[name]), policy)).drop("__llm_m")


def patterns(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., bits, n``: how many entries share a failure pattern."""
    return entries.groupBy(*by, "bits").agg(F.count("*").alias("n"))


def ablations(
    entries: DataFrame, policies: Sequence[Policy] = tuple(POLICIES.values()), by: Sequence[str] = (), rules: Sequence[Rule] = RULES
) -> DataFrame:
    """What every rule of every policy does, per group.

    ``by..., version, rule, n, n_kept, n_failed, n_kept_without, ever, always``: entries, entries the
    policy keeps, entries that fail the rule, entries that it would keep without the rule; the rules
    that some entry (``ever``) and every entry (``always``) rejected by the policy fails, as bits.
    """
    counted = patterns(entries, by)
    parts = []
    for p in policies:
        kept = passes("bits", p)
        for i, r in enumerate(rules):
            bit = 1 << i
            if not (p.hard | p.weak) & bit:
                continue
            without = Policy(p.version, p.hard & ~bit, p.weak & ~bit, p.limit)
            parts.append(
                F.struct(
                    F.lit(p.version).alias("version"),
                    F.lit(r.name).alias("rule"),
                    kept.alias("kept"),
                    (F.col("bits").bitwiseAND(bit) != 0).alias("failed"),
                    passes("bits", without).alias("without"),
                )
            )
    each = counted.select(*by, "bits", "n", F.explode(F.array(*parts)).alias("x")).select(*by, "bits", "n", "x.*")
    total = lambda on: F.sum(F.when(F.col(on), F.col("n")).otherwise(0)).alias
    rejected = F.when(~F.col("kept"), F.col("bits"))
    return each.groupBy(*by, "version", "rule").agg(
        F.sum("n").alias("n"),
        total("kept")("n_kept"),
        total("failed")("n_failed"),
        total("without")("n_kept_without"),
        F.bit_or(rejected).alias("ever"),
        F.bit_and(rejected).alias("always"),
    )


def digest(docs: DataFrame) -> DataFrame:
    entries = ledger(docs)
    return entries.select(
        "doc_id",
        *[m for m in MEASURES],
        "bits",
        (~passes("bits", BASE)).alias("base_failed"),
        passes("bits", POLICIES[CURRENT]).alias("kept"),
    )


SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
dl AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
x AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
g AS (SELECT r, pos, word = lag(word) OVER o AS echo, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o
    || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram FROM x WINDOW o AS (PARTITION BY r ORDER BY pos)),
f AS (SELECT r, gram FROM g WHERE gram IS NOT NULL GROUP BY r, gram HAVING count(*) > 1),
c AS (SELECT r, count(DISTINCT pos + j) AS n_repeat_words FROM g JOIN f USING (r, gram), range(5) AS s(j) GROUP BY r),
e AS (SELECT r, count(*) AS n_echo_words FROM g WHERE echo GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_echo_words, 0)::BIGINT AS n_echo_words
  FROM t JOIN w USING (r) LEFT JOIN dl USING (r) LEFT JOIN c USING (r) LEFT JOIN e USING (r)),
b AS (SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT
    + 64 * (25 * n_symbols > n_words)::INT + 128 * (100 * n_dup_lines > 15 * n_lines)::INT
    + 256 * (100 * n_repeat_words > 10 * n_words)::INT + 512 * (100 * n_echo_words > 30 * n_words)::INT)::BIGINT AS bits FROM m)
SELECT *, bits & 3 <> 0 AS base_failed, bits & 567 = 0 AND bit_count(bits & 448) < 3 AS kept FROM b"""
