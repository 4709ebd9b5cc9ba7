"""Text projections over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from effnum.functions import text as tx
from effnum.operators import cooccur, encode, phonology, tokens

from .registry import query, rounded, table

CLEAN = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<br\s*/?>', ' ', 'g'), "
    r"'\.{2,}', '. ', 'g'), '([.!?])', '\1 ', 'g'), '\s+', ' ', 'g'))"
)
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query("clean_text", f"SELECT doc_id, md5({CLEAN}) AS cleaned FROM documents")
def clean_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(tx.clean_text("text")).alias("cleaned"))


@query(
    "sentences_by_document",
    r"""SELECT doc_id, (generate_subscripts(s, 1) - 1)::INTEGER AS pos, md5(unnest(s)) AS sentence FROM (
      SELECT doc_id, list_filter(list_transform(string_split(
        regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
        lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)""",
)
def sentences_by_document(spark, folder):
    docs = table(spark, folder, "documents")
    parts = docs.select("doc_id", F.posexplode(tx.sentences("text")).alias("pos", "s"))
    return parts.select("doc_id", "pos", F.md5("s").alias("sentence"))


@query(
    "clauses_by_turn",
    r"""SELECT conv_id, turn, (generate_subscripts(s, 1) - 1)::INTEGER AS pos, unnest(s) AS clause FROM (
      SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'),
        lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM conversations)""",
)
def clauses_by_turn(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", F.posexplode(tx.clauses("text")).alias("pos", "clause"))


@query(
    "chunks_by_document",
    f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
    c AS (SELECT doc_id, w, greatest(3, len(w) // 3) AS step FROM w WHERE len(w) > 0),
    e AS (SELECT doc_id, w, step, unnest(range(0, len(w), step)) AS i FROM c)
    SELECT doc_id, (i // step)::INTEGER AS pos, md5(array_to_string(w[i + 1:i + step], ' ')) AS chunk FROM e""",
)
def chunks_by_document(spark, folder):
    docs = table(spark, folder, "documents")
    parts = docs.select("doc_id", F.posexplode(tx.word_chunks("text")).alias("pos", "c"))
    return parts.select("doc_id", "pos", F.md5("c").alias("chunk"))


@query(
    "text_statistics",
    rf"""WITH w AS (SELECT doc_id, text, {WORDS} AS w FROM documents)
    SELECT doc_id,
      regexp_matches(text, '\S') AS non_blank,
      round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END, 6) AS unique_ratio,
      round(len(list_distinct(list_transform(w, lambda x: least(len(regexp_extract_all(x, '[aeiouAEIOU]')), 5)))) / 5, 6)
        AS vowel_variety,
      round(len(list_distinct(list_transform(w, lambda x:
        CASE WHEN x = upper(x) AND x <> lower(x) THEN 'UPPER'
             WHEN x[1] = upper(x[1]) AND x[1] <> lower(x[1]) THEN 'Title'
             WHEN x = lower(x) AND x <> upper(x) THEN 'lower' ELSE 'mixed' END))) / 4, 6) AS shape_variety,
      round(least(1.0, len(w) / 20), 6) AS length_proxy
    FROM w""",
)
def text_statistics(spark, folder):
    out = table(spark, folder, "documents").select(
        "doc_id",
        tx.non_blank("text").alias("non_blank"),
        tx.unique_word_ratio("text").alias("unique_ratio"),
        tx.vowel_variety("text").alias("vowel_variety"),
        tx.shape_variety("text").alias("shape_variety"),
        tx.length_proxy("text").alias("length_proxy"),
    )
    return rounded(out, "unique_ratio", "vowel_variety", "shape_variety", "length_proxy")


@query(
    "strip_punctuation",
    r"""SELECT conv_id, turn, regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g') AS stripped FROM conversations""",
)
def strip_punctuation(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", tx.strip_punctuation("text").alias("stripped"))


def pieces(spark, folder):
    """Conversation words cut into pieces of four letters, later pieces marked, each
    with a small vector."""
    turns = table(spark, folder, "conversations")
    words = turns.select("conv_id", "turn", F.posexplode(tx.tokens("text")).alias("w", "word"))
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("word") - 1) / 4).cast("int")),
        lambda i: F.concat(F.when(i > 0, "##").otherwise(""), F.substr("word", i * 4 + 1, F.lit(4))),
    )
    rows = words.select("conv_id", "turn", "w", F.posexplode(cut).alias("k", "token"))
    return rows.select(
        "conv_id",
        F.col("turn").alias("doc_id"),
        (F.col("w") * 1000 + F.col("k")).alias("pos"),
        "token",
        F.array(F.col("k").cast("double"), F.length("token").cast("double"), F.lit(1.0)).alias("vec"),
    )


PIECES = r"""
    WITH toks AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM conversations),
    words AS (SELECT conv_id, turn, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS w FROM toks),
    pieces AS (SELECT conv_id, turn AS doc_id, w, word, unnest(range(0, (length(word) - 1) // 4 + 1)) AS k FROM words),
    parts AS (SELECT *, substr(word, k * 4 + 1, 4) AS piece FROM pieces)"""


@query(
    "merge_subwords",
    f"""{PIECES}
    SELECT conv_id, doc_id, w AS word_no, any_value(word) AS word, round(avg(k), 6) AS v0,
      round(avg(length(piece) + CASE WHEN k > 0 THEN 2 ELSE 0 END), 6) AS v1
    FROM parts GROUP BY conv_id, doc_id, w""",
)
def merge_subwords(spark, folder):
    merged = tokens.merge_subwords(pieces(spark, folder), ["conv_id"])
    out = merged.select("conv_id", "doc_id", "word_no", "word", F.col("vec")[0].alias("v0"), F.col("vec")[1].alias("v1"))
    return rounded(out, "v0", "v1")


@query(
    "subword_scheme",
    f"""{PIECES}
    SELECT conv_id, CASE WHEN max(k) > 0 THEN 'wordpiece' END AS scheme FROM parts GROUP BY conv_id""",
)
def subword_scheme(spark, folder):
    return tokens.detect_subword_scheme(pieces(spark, folder), ["conv_id"])


STOP = ["the", "of", "and", "le", "la", "les", "der", "die", "und", "el", "los", "que"]


@query(
    "filtered_tokens",
    r"""WITH t AS (SELECT role, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS token
      FROM conversations)
    SELECT role, token, count(*) AS n FROM t
    WHERE token NOT IN ('the','of','and','le','la','les','der','die','und','el','los','que','en')
      AND token NOT IN ('!','(',')','-','[',']','{','}',';',':','''','"',',','<','>','.','/','?','@','#','$','%','^','&','*','_','~')
    GROUP BY ALL""",
)
def filtered_tokens(spark, folder):
    turns = table(spark, folder, "conversations")
    marks = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+|(?U)[^\p{L}\p{N}_\s]"), F.lit(0))
    rows = turns.select("role", F.explode(marks).alias("token"))
    kept = tokens.drop_punctuation(tokens.drop_stopwords(tokens.drop_special(rows, ["en", None]), STOP))
    return kept.groupBy("role", "token").agg(F.count("*").alias("n"))


@query(
    "tags_to_symbols",
    rf"""WITH w AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations),
    s AS (SELECT conv_id, turn, list_transform(w, lambda x:
        CASE WHEN x = upper(x) AND x <> lower(x) THEN 'UPPER'
             WHEN x[1] = upper(x[1]) AND x[1] <> lower(x[1]) THEN 'Title'
             WHEN x = lower(x) AND x <> upper(x) THEN 'lower' ELSE 'mixed' END) AS t FROM w),
    d AS (SELECT conv_id, list_sort(list_distinct(flatten(list(t)))) AS names FROM s GROUP BY conv_id)
    SELECT s.conv_id, turn, array_to_string(list_transform(t, lambda x: chr((64 + list_position(names, x))::INTEGER)), '') AS symbols
    FROM s JOIN d ON s.conv_id = d.conv_id""",
)
def tags_to_symbols(spark, folder):
    from effnum.operators.sequences import tags_to_symbols as symbols

    turns = table(spark, folder, "conversations").select("conv_id", "turn", tx.shape_tags("text").alias("tags"))
    return symbols(turns, ["conv_id"], "turn", "tags")


HEAVY = "ee|oo|ea|ai|ay|ey|ie|oa|ue|ou|oi|oy|ow|au|aw"
FIRST = "regexp_extract(x, '^[^aeiouy]*[aeiouy]+([^aeiouy]+$)?')"


@query(
    "rhythm_codes",
    rf"""WITH c AS (SELECT conv_id, turn, regexp_replace({CLEAN}, '[!-/:-@\[-`{{-~]', '', 'g') AS t FROM conversations),
    w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+'),
        lambda x: regexp_full_match(x, '[a-z]+')) AS w FROM c),
    k AS (SELECT conv_id, turn, list_transform(w, lambda x:
        (CASE WHEN len(regexp_extract_all(x, '[aeiouy]+')) <= 2 THEN '1' ELSE '0' END) ||
        (CASE WHEN regexp_matches(CASE WHEN {FIRST} <> '' THEN {FIRST} ELSE x END, '{HEAVY}|[^aeiou]$')
          THEN '1' ELSE '0' END)) AS r FROM w)
    SELECT conv_id, turn, array_to_string(r, ' ') AS rhythm FROM k""",
)
def rhythm_codes(spark, folder):
    turns = table(spark, folder, "conversations")
    codes = phonology.rhythm_codes(turns, ["conv_id", "turn"])
    return codes.select("conv_id", "turn", F.array_join("rhythm", " ").alias("rhythm"))


@query(
    "phonemes_spelled",
    rf"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower({CLEAN}), '[\p{{L}}\p{{N}}_]+') AS w FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter(string_split(array_to_string(w, ''), ''),
      lambda x: x <> ''), ' ') AS phonemes FROM c""",
)
def phonemes_spelled(spark, folder):
    turns = table(spark, folder, "conversations")
    return phonology.phonemes(turns, ["conv_id", "turn"])


def derived_lexicon(spark, folder):
    """A lexicon of the benchmark's words: letters as phones, vowels stressed by turns."""
    items = table(spark, folder, "benchmark")
    words = items.select(F.explode(tx.tokens("text")).alias("word")).distinct()
    letters = F.filter(F.split(F.upper("word"), ""), lambda c: c != "")
    phones = F.transform(
        letters,
        lambda c, i: F.when(c.rlike("[AEIOU]"), F.concat(c, (i % 2).cast("string"))).otherwise(c),
    )
    from effnum.functions import sound as so

    return words.select(
        "word",
        phones.alias("phones"),
        so.syllables(F.col("word")).alias("syllables"),
        F.when(F.length("word") <= 3, "DET").otherwise("NOUN").alias("pos"),
    )


@query(
    "pos_tags_from_lexicon",
    rf"""WITH lex AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM benchmark),
    c AS (SELECT conv_id, turn, regexp_extract_all(lower({CLEAN}), '[\p{{L}}\p{{N}}_]+') AS w FROM conversations),
    e AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM c),
    t AS (SELECT conv_id, turn, i, CASE WHEN lex.word IS NULL THEN 'X' WHEN length(lex.word) <= 3 THEN 'DET'
      ELSE 'NOUN' END AS tag FROM e LEFT JOIN lex USING (word))
    SELECT conv_id, turn, string_agg(tag, ' ' ORDER BY i) AS tags FROM t GROUP BY conv_id, turn""",
)
def pos_tags(spark, folder):
    turns = table(spark, folder, "conversations")
    tags = phonology.pos_tags(turns, ["conv_id", "turn"], "text", derived_lexicon(spark, folder))
    return tags.select("conv_id", "turn", F.array_join("tags", " ").alias("tags"))


# The first vowel letter of a listed word bears stress where its place, from 0, is odd.
VOWEL_AT = "length(regexp_extract(x, '^[^aeiou]*'))"


@query(
    "rhythm_from_lexicon",
    rf"""WITH lex AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM benchmark),
    c AS (SELECT conv_id, turn, regexp_replace({CLEAN}, '[!-/:-@\[-`{{-~]', '', 'g') AS t FROM conversations),
    w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+'),
        lambda x: regexp_full_match(x, '[a-z]+')) AS w FROM c),
    e AS (SELECT conv_id, turn, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
    k AS (SELECT conv_id, turn, i,
        CASE WHEN lex.word IS NULL THEN len(regexp_extract_all(x, '[aeiouy]+')) <= 2
             ELSE {VOWEL_AT} < length(x) AND {VOWEL_AT} % 2 = 1 END AS stress,
        regexp_matches(CASE WHEN {FIRST} <> '' THEN {FIRST} ELSE x END, '{HEAVY}|[^aeiou]$') AS weight
      FROM e LEFT JOIN lex ON lex.word = x),
    r AS (SELECT conv_id, turn, string_agg(stress::INTEGER || '' || weight::INTEGER, ' ' ORDER BY i) AS rhythm
      FROM k GROUP BY ALL)
    SELECT conv_id, turn, coalesce(rhythm, '') AS rhythm FROM w LEFT JOIN r USING (conv_id, turn)""",
)
def rhythm_from_lexicon(spark, folder):
    turns = table(spark, folder, "conversations")
    codes = phonology.rhythm_codes(turns, ["conv_id", "turn"], "text", derived_lexicon(spark, folder))
    return codes.select("conv_id", "turn", F.array_join("rhythm", " ").alias("rhythm"))


@query(
    "phonemes_from_lexicon",
    rf"""WITH lex AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM benchmark),
    c AS (SELECT conv_id, turn, regexp_extract_all(lower({CLEAN}), '[\p{{L}}\p{{N}}_]+') AS w FROM conversations),
    e AS (SELECT conv_id, turn, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM c),
    p AS (SELECT conv_id, turn, i, CASE WHEN lex.word IS NULL THEN string_split(x, '')
        ELSE list_transform(string_split(upper(replace(x, 'ß', 'ss')), ''), lambda l, k:
          CASE WHEN regexp_matches(l, '[AEIOU]') THEN l || ((k - 1) % 2) ELSE l END) END AS ph
      FROM e LEFT JOIN lex ON lex.word = x),
    r AS (SELECT conv_id, turn, string_agg(array_to_string(ph, ' '), ' ' ORDER BY i) AS phonemes FROM p GROUP BY ALL)
    SELECT conv_id, turn, coalesce(phonemes, '') AS phonemes FROM c LEFT JOIN r USING (conv_id, turn)""",
)
def phonemes_from_lexicon(spark, folder):
    turns = table(spark, folder, "conversations")
    return phonology.phonemes(turns, ["conv_id", "turn"], "text", derived_lexicon(spark, folder))


@query("word_analysis")
def word_analysis(spark, folder):
    return phonology.analyze(table(spark, folder, "documents"), "doc_id")


@query("encode_hashed_words")
def encode_hashed_words(spark, folder):
    return encode.hashed_words(table(spark, folder, "documents")).select("doc_id", "vec")


@query("encode_tfidf")
def encode_tfidf(spark, folder):
    return encode.tfidf(table(spark, folder, "documents"), dim=64).select("doc_id", "vec")


@query(
    "encode_custom",
    r"SELECT doc_id, length(text)::DOUBLE AS v0, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS v1 FROM documents",
)
def encode_custom(spark, folder):
    def load():
        import numpy as np

        return lambda texts: np.array([[len(t), t.count("e")] for t in texts], dtype=float)

    out = encode.encode(table(spark, folder, "documents").select("doc_id", "text"), load)
    return out.select("doc_id", F.col("vec")[0].alias("v0"), F.col("vec")[1].alias("v1"))


@query("document_vectors_word2vec")
def word2vec(spark, folder):
    turns = table(spark, folder, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    vectors = encode.word_vectors(turns, dim=16)
    return encode.mean_of_words(turns, vectors, "id").select("id.conv_id", "id.turn", "vec")


@query(
    "word_cooccurrences",
    r"""
    WITH toks AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM conversations),
    pos AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM toks),
    near AS (SELECT t[i] AS x, t[i + k] AS y FROM pos, (SELECT unnest([1, 2]) AS k) WHERE i + k <= len(t)),
    ends AS (SELECT x AS a, y AS b FROM near UNION ALL SELECT y AS a, x AS b FROM near)
    SELECT a, b, count(*) AS n FROM ends GROUP BY ALL""",
)
def word_cooccurrences(spark, folder):
    return cooccur.cooccurrences(table(spark, folder, "conversations"), reach=2)


@query(
    "word_associations",
    r"""
    WITH toks AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM conversations),
    pos AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM toks),
    near AS (SELECT t[i] AS x, t[i + k] AS y FROM pos, (SELECT unnest([1, 2]) AS k) WHERE i + k <= len(t)),
    ends AS (SELECT x AS a, y AS b FROM near UNION ALL SELECT y AS a, x AS b FROM near),
    n AS (SELECT a, b, count(*) AS n FROM ends GROUP BY ALL),
    tot AS (SELECT a, sum(n) AS s FROM n GROUP BY a)
    SELECT n.a, n.b, round(ln(n.n * (SELECT sum(s) FROM tot)::DOUBLE / (l.s::DOUBLE * r.s::DOUBLE)), 6) AS m
    FROM n JOIN tot l ON l.a = n.a JOIN tot r ON r.a = n.b
    WHERE ln(n.n * (SELECT sum(s) FROM tot)::DOUBLE / (l.s::DOUBLE * r.s::DOUBLE)) > 0.000001""",
)
def word_associations(spark, folder):
    pairs = cooccur.cooccurrences(table(spark, folder, "conversations"), reach=2)
    found = cooccur.associations(pairs)
    # Associations of zero, which rounding may leave on either side, are in neither.
    return rounded(found.where(F.col("m") > 0.000001), "m")


@query("document_vectors_cooccurrence")
def cooccurrence_vectors(spark, folder):
    turns = table(spark, folder, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    vectors = cooccur.word_vectors(turns, dim=16)
    return encode.mean_of_words(turns, vectors, "id").select("id.conv_id", "id.turn", "vec")
