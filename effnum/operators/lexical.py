"""Lexical baselines: type-token ratio, distinct-n, self-BLEU."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import keyed, unkeyed

# Fixed value: stands in for a match count of zero (smoothing method 1 of
# Chen and Cherry, 2014).
SMOOTHING = 0.1
GROUP_TOKENS = 1 << 14  # words of a group that are counted in one row

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (SplitMix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_n(
    df: DataFrame,
    by: Sequence[str] = (),
    text: str = "text",
    n: int = 1,
    lowercase: bool = True,
    approximate: bool = False,
) -> DataFrame:
    """Distinct n-grams over n-grams per group: ``by..., n_total, n_distinct, value``.

    The distinct count shuffles on (group, n-gram) after a map-side combine, so a
    group holding most of the rows is spread over all partitions. An n-gram travels as
    128 bits of hash. ``approximate`` uses a sketch instead and shuffles one row per group and partition.
    """
    src, keys = keyed(df, by)
    toks = src.select(*keys, tx.tokens(text, lowercase).alias("_toks"))
    # explode_outer keeps groups without a single n-gram. A shifted array for every place of an
    # n-gram: its words are hashed where they are exploded, and no n-gram is written as a string.
    length = F.greatest(F.size("_toks") - F.lit(n - 1), F.lit(0))
    places = F.arrays_zip(*[F.slice("_toks", F.lit(k + 1), length).alias(f"w{k}") for k in range(n)])
    words = toks.select(*keys, F.explode_outer(places).alias("_g"))
    gram = [F.col(f"_g.w{k}") for k in range(n)]
    found = F.col("_g").isNotNull()
    grams = words.select(
        *keys, F.when(found, F.xxhash64(*gram)).alias("_a"), F.when(found, F.xxhash64(F.lit(1), *gram)).alias("_b")
    )
    if approximate:
        out = grams.groupBy(*keys).agg(
            F.count("_a").alias("n_total"), F.approx_count_distinct("_a", 0.02).cast("bigint").alias("n_distinct")
        )
    else:
        counted = grams.groupBy(*keys, "_a", "_b").agg(F.count("_a").alias("_c"))
        out = counted.groupBy(*keys).agg(F.sum("_c").alias("n_total"), F.count("_a").alias("n_distinct"))
    ratio = F.coalesce(F.try_divide(F.col("n_distinct"), F.col("n_total")), F.lit(0.0))
    return unkeyed(by, out.withColumn("value", ratio))


def type_token_ratio(
    df: DataFrame,
    by: Sequence[str] = (),
    text: str = "text",
    lowercase: bool = True,
    approximate: bool = False,
) -> DataFrame:
    """Distinct tokens over tokens per group."""
    return distinct_n(df, by, text, 1, lowercase, approximate)


def occurrences(docs: DataFrame, keys: list[str], id: str, max_n: int) -> DataFrame:
    """``keys..., id, n, gram, nth``: every n-gram occurrence of a document, numbered among
    the document's occurrences of that n-gram.

    A document's n-grams are sorted and numbered inside its row, before anything is
    shuffled. ``gram`` is 128 bits of hash instead of the text.
    """
    per_order = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.sort_array(tx.ngrams(F.col("_toks"), n)).alias("grams"))
            for n in range(1, max_n + 1)
        ]
    )
    rows = docs.select(*keys, id, F.explode(per_order).alias("_o")).select(
        *keys, id, F.col("_o.n").alias("n"), F.col("_o.grams").alias("_g")
    )
    grams, size = F.col("_g"), F.size("_g")
    # The previous n-gram of the sorted array; equal ones are neighbours.
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(grams, 1, F.greatest(size - 1, F.lit(0))))
    places = F.zip_with(grams, before, lambda g, b: ~g.eqNullSafe(b))
    starts = F.filter(
        F.transform(places, lambda first, k: F.when(first, k)), lambda k: k.isNotNull()
    )
    rows = rows.select(*keys, id, "n", "_g", starts.alias("_s"))
    ends = F.concat(F.slice("_s", 2, F.size("_s")), F.array(F.size("_g")))
    runs = F.zip_with(
        "_s", ends, lambda a, b: F.struct(F.get(F.col("_g"), a).alias("gram"), (b - a).alias("cnt"))
    )
    counted = rows.select(*keys, id, "n", F.explode(runs).alias("_r"))
    gram = F.struct(F.xxhash64("_r.gram").alias("a"), F.xxhash64(F.lit(1), "_r.gram").alias("b"))
    return counted.select(*keys, id, "n", gram.alias("gram"), F.explode(F.sequence(F.lit(1), F.col("_r.cnt"))).alias("nth"))


def lost_matches(grams: DataFrame, keys: list[str], id: str, max_n: int) -> DataFrame:
    """``keys..., id, lost_1 .. lost_n`` from numbered n-grams: the matches that clipping
    takes from a document, per order. Documents that lose none have no row.

    A document's count of an n-gram is clipped at the largest count in any other
    document. So an occurrence is lost where no other document has as many: where the
    document alone holds the n-gram's occurrence of that number. One aggregate of a
    count and a smallest owner decides that; it is combined map-side, and no state grows
    with the number of documents or of different counts.
    """
    holders = grams.groupBy(*keys, "n", "gram.a", "gram.b", "nth").agg(
        F.count("*").alias("_h"), F.min(id).alias("_owner")
    )
    alone = holders.where(F.col("_h") == 1).select(*keys, F.col("_owner").alias(id), "n")
    return alone.groupBy(*keys, id).agg(
        *[F.count_if(F.col("n") == n).alias(f"lost_{n}") for n in range(1, max_n + 1)]
    )


def closest_lengths(docs: DataFrame, keys: list[str], length: str = "len") -> DataFrame:
    """``keys..., len, ref_len``: for every document length of a group the nearest
    length of another document, the shorter one on a tie.

    Works on the histogram of lengths. A length held twice is its own nearest;
    otherwise the answer is one of its two neighbours.
    """
    histogram = docs.groupBy(*keys, length).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(length)
    below, above = F.lag(length).over(w), F.lead(length).over(w)
    x = F.col(length)
    nearest = (
        F.when(F.col("_c") >= 2, x)
        .when(below.isNull(), above)
        .when(above.isNull(), below)
        .when(x - below <= above - x, below)
        .otherwise(above)
    )
    return histogram.select(*keys, length, nearest.alias("ref_len"))


def _spread_bleu(src: DataFrame, keys: list[str], id: str, text: str, max_n: int, lowercase: bool) -> DataFrame:
    """:func:`document_bleu` for groups of any size."""
    docs = src.select(*keys, id, tx.tokens(text, lowercase).alias("_toks"))
    # Exploding the length, or nothing, leaves texts without tokens out. A filter would be
    # pushed below the projection and find the tokens of every text a second time.
    length = F.filter(F.array(F.size("_toks")), lambda x: x > 0)
    lengths = docs.select(*keys, id, F.explode(length).alias("len"))
    lost = lost_matches(occurrences(docs, keys, id, max_n), keys, id, max_n)
    out = (
        lengths.join(closest_lengths(lengths, keys), [*keys, "len"])
        .where(F.col("ref_len").isNotNull())
        .join(lost, [*keys, id], "left")
    )
    logs = F.lit(0.0)
    for n in range(1, max_n + 1):
        # A document's n-grams follow from its length; one too short for an order has a
        # smoothed count over one there.
        total = F.greatest(F.col("len") - F.lit(n - 1), F.lit(0))
        clipped = total - F.coalesce(F.col(f"lost_{n}"), F.lit(0))
        numerator = F.when(clipped > 0, clipped.cast("double")).otherwise(SMOOTHING)
        logs = logs + F.log(numerator / F.greatest(total, F.lit(1)))
    precision = F.exp(logs / F.lit(float(max_n)))
    brevity = F.when(F.col("len") > F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(F.lit(1.0) - F.col("ref_len") / F.col("len"))
    )
    shared = F.col("len") > F.coalesce(F.col("lost_1"), F.lit(0))
    bleu = F.when(shared, brevity * precision).otherwise(F.lit(0.0))
    return out.select(*keys, id, bleu.alias("bleu"))


def _small_groups(group: np.ndarray, who: np.ndarray, offsets: np.ndarray, words: np.ndarray, max_n: int) -> np.ndarray:
    """BLEU of every document against the others of its group; NaN where there is none to give.

    ``group`` numbers the documents' groups, ``who`` their ids (-1: none), ``words`` are the hashes of the
    documents' words, one document after another. All groups are counted together.
    """
    n, length = len(group), np.diff(offsets)
    ends = np.repeat(offsets[1:], length)
    doc = np.repeat(np.arange(n), length)
    _, person = np.unique(np.stack([group, who]), axis=1, return_inverse=True)
    person = person.ravel()
    logs, shared = np.zeros(n), np.zeros(n)
    gram = np.zeros(len(words), np.uint64)
    for k in range(1, max_n + 1):
        here = np.flatnonzero(np.arange(len(words)) + k <= ends)
        gram[here] = _spread(gram[here] * _ODD + words[here + k - 1])
        g, d = gram[here], doc[here]
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
        first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])][: len(g)])
        g, d, count = g[first], d[first], np.diff(np.r_[first, len(g)])
        # Of a group's counts of an n-gram only the largest can be clipped: to the second one.
        order = np.lexsort((-count, g, group[d]))
        g, d, count = g[order], d[order], count[order]
        top = np.r_[True, (g[1:] != g[:-1]) | (group[d[1:]] != group[d[:-1]])][: len(g)]
        second = np.where(np.r_[top[1:], True][: len(g)], 0, np.r_[count[1:], 0][: len(g)])
        lost = np.bincount(person[d[top]], (count - second)[top], minlength=int(person.max(initial=0)) + 1)[person]
        lost = np.where(who < 0, 0, lost)
        total = np.maximum(length - (k - 1), 0)
        clipped = total - lost
        logs += np.log(np.where(clipped > 0, clipped, SMOOTHING) / np.maximum(total, 1))
        if k == 1:
            shared = length > lost
    # The nearest length of another document of the group, the shorter one on a tie.
    order = np.lexsort((length, group))
    order = order[length[order] > 0]
    size, mine = length[order].astype(np.float64), group[order]
    same = mine[1:] == mine[:-1]
    below = np.r_[np.nan, np.where(same, size[:-1], np.nan)][: len(size)]
    above = np.r_[np.where(same, size[1:], np.nan), np.nan][: len(size)]
    nearest = np.full(n, np.nan)
    nearest[order] = np.where(np.isnan(above) | (size - below <= above - size), below, above)
    brevity = np.where(length > nearest, 1.0, np.exp(1.0 - nearest / np.maximum(length, 1)))
    return np.where(np.isnan(nearest), np.nan, np.where(shared, brevity * np.exp(logs / max_n), 0.0))


def _bleu_of_groups(max_n: int):
    @F.arrow_udf("array<double>")
    def bleu(ids: pa.Array, texts: pa.Array) -> pa.Array:
        groups, docs = texts.offsets.to_numpy(), texts.values.offsets.to_numpy()
        words = texts.values.values.to_numpy(zero_copy_only=False).view(np.uint64)
        who = pc.fill_null(ids.values.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        shift = int(ids.offsets[0].as_py()) - int(groups[0]) if len(ids) else 0
        parts, lo = [np.zeros(0)], 0
        while lo < len(texts):
            # As many groups as have some ``GROUP_TOKENS`` words together.
            hi = max(lo + 1, int(np.searchsorted(docs[groups], docs[groups[lo]] + GROUP_TOKENS, side="right")) - 1)
            hi = min(hi, len(texts))
            a, b = int(groups[lo]), int(groups[hi])
            number = np.repeat(np.arange(hi - lo), np.diff(groups[lo : hi + 1]))
            mine = words[docs[a] : docs[b]]
            parts.append(_small_groups(number, who[a + shift : b + shift], docs[a : b + 1] - docs[a], mine, max_n))
            lo = hi
        flat = np.concatenate(parts)
        return pa.ListArray.from_arrays(pa.array((groups - groups[0]).astype(np.int32)), pa.array(flat, mask=np.isnan(flat)))

    return bleu


def document_bleu(
    df: DataFrame,
    by: Sequence[str] = (),
    id: str = "doc_id",
    text: str = "text",
    max_n: int = 4,
    lowercase: bool = True,
) -> DataFrame:
    """BLEU of every document against all others of its group: ``by..., id, bleu``.

    ``id`` names a document within its group once.

    Documents without tokens are left out, as are groups with fewer than two. Groups of up to
    ``GROUP_TOKENS`` words are one row each, so that their words are shuffled and not their n-grams;
    the n-grams of larger ones are dealt over all partitions.
    """
    src, keys = keyed(df, by)
    words = src.select(*keys, F.size(tx.tokens(text, lowercase)).cast("bigint").alias("_len"))
    sizes = words.groupBy(*keys).agg(F.sum("_len").alias("_words"))
    fits = F.col("_words") <= GROUP_TOKENS
    hashed = F.transform(tx.tokens(text, lowercase), lambda t: F.xxhash64(t))
    few = src.join(sizes.where(fits).select(*keys), keys, "left_semi").select(*keys, id, hashed.alias("_t"))
    rows = few.where(F.col("_t").isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct(F.col(id).alias("_id"), "_t")).alias("_d"))
    scored = rows.withColumn("_b", _bleu_of_groups(max_n)(F.col("_d._id"), F.col("_d._t")))
    each = scored.select(*keys, F.explode(F.arrays_zip(F.col("_d._id").alias("_id"), "_b")).alias("_r"))
    small = each.select(*keys, F.col("_r._id").alias(id), F.col("_r._b").alias("bleu")).where(F.col("bleu").isNotNull())
    large = src.join(sizes.where(~fits).select(*keys), keys, "left_semi")
    return unkeyed(by, small.unionByName(_spread_bleu(large, keys, id, text, max_n, lowercase)))


def self_bleu(
    df: DataFrame,
    by: Sequence[str] = (),
    id: str = "doc_id",
    text: str = "text",
    max_n: int = 4,
    lowercase: bool = True,
) -> DataFrame:
    """Mean BLEU of a group's documents against each other: ``by..., n_docs, value``.

    Lower means more diverse. Groups with fewer than two usable documents give 0.
    """
    src, keys = keyed(df, by)
    bleu = document_bleu(src, keys, id, text, max_n, lowercase).withColumnRenamed("bleu", "_b")
    # Every group keeps a row, whether or not any of its documents was scored.
    groups = src.select(*keys, F.lit(None).cast("double").alias("_b")).distinct()
    out = (
        bleu.select(*keys, "_b")
        .unionByName(groups)
        .groupBy(*keys)
        .agg(F.count("_b").alias("n_docs"), F.coalesce(F.avg("_b"), F.lit(0.0)).alias("value"))
    )
    return unkeyed(by, out)
