"""Lexical baselines over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from effnum.functions import text as tx
from effnum.operators import lexical

from .registry import query, rounded, table

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _ratio_sql(source: str, by: str, n: int) -> str:
    key = f"{by}, " if by else ""
    grams = (
        f"SELECT {key}unnest(t) AS gram FROM toks"
        if n == 1
        else f"SELECT {key}unnest(CASE WHEN len(t) >= {n} THEN list_transform(range(1, len(t) - {n} + 2), "
        f"lambda i: array_to_string(t[i:i+{n - 1}], ' ')) ELSE [] END) AS gram FROM toks"
    )
    group = f" GROUP BY {by}" if by else ""
    return f"""
    WITH toks AS (SELECT {key}{TOKENS} AS t FROM {source}),
    grams AS ({grams})
    SELECT {key}count(*) AS n_total, count(DISTINCT gram) AS n_distinct,
      round(count(DISTINCT gram) / count(*), 6) AS value
    FROM grams{group}"""


@query("ttr_by_lang", _ratio_sql("documents", "lang", 1))
def ttr_by_lang(spark, folder):
    docs = table(spark, folder, "documents")
    return rounded(lexical.type_token_ratio(docs, ["lang"]), "value")


@query("ttr_whole_corpus", _ratio_sql("documents", "", 1))
def ttr_whole_corpus(spark, folder):
    return rounded(lexical.type_token_ratio(table(spark, folder, "documents")), "value")


@query("distinct2_by_source", _ratio_sql("documents", "source", 2))
def distinct2_by_source(spark, folder):
    docs = table(spark, folder, "documents")
    return rounded(lexical.distinct_n(docs, ["source"], n=2), "value")


@query("distinct3_by_role", _ratio_sql("conversations", "role", 3))
def distinct3_by_role(spark, folder):
    turns = table(spark, folder, "conversations")
    return rounded(lexical.distinct_n(turns, ["role"], n=3), "value")


def _bleu_sql(source: str, by: str, id: str) -> str:
    return f"""
    WITH toks AS (SELECT {by} AS g, {id} AS d, {TOKENS} AS t FROM {source}),
    docs AS (SELECT g, d, t, len(t) AS l FROM toks WHERE len(t) > 0),
    grams AS (SELECT g, d, n, unnest(CASE WHEN l >= n THEN list_transform(range(1, l - n + 2),
        lambda i: array_to_string(t[i:i+n-1], ' ')) ELSE [] END) AS gram
      FROM docs, (SELECT unnest([1, 2, 3, 4]) AS n)),
    cnt AS (SELECT g, d, n, gram, count(*) AS c FROM grams GROUP BY ALL),
    best AS (SELECT a.g, a.d, a.n, a.gram, any_value(a.c) AS c, coalesce(max(b.c), 0) AS o
      FROM cnt a LEFT JOIN cnt b ON a.g = b.g AND a.n = b.n AND a.gram = b.gram AND a.d <> b.d
      GROUP BY ALL),
    per AS (SELECT g, d, n, sum(least(c, o)) AS clipped, sum(c) AS total FROM best GROUP BY ALL),
    allper AS (SELECT docs.g, docs.d, docs.l, m.n, coalesce(per.clipped, 0) AS clipped,
        coalesce(per.total, 0) AS total
      FROM docs CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) m
      LEFT JOIN per ON per.g = docs.g AND per.d = docs.d AND per.n = m.n),
    prec AS (SELECT g, d, l, exp(sum(ln((CASE WHEN clipped > 0 THEN clipped ELSE 0.1 END)
        / greatest(1, total))) / 4) AS pr,
        max(CASE WHEN n = 1 THEN clipped END) AS uni FROM allper GROUP BY ALL),
    lens AS (SELECT a.g, a.d, arg_min(b.l, abs(b.l - a.l) * 1000000 + b.l) AS r
      FROM docs a JOIN docs b ON a.g = b.g AND a.d <> b.d GROUP BY ALL),
    bleu AS (SELECT prec.g, CASE WHEN uni = 0 THEN 0.0
        ELSE pr * (CASE WHEN l > r THEN 1.0 ELSE exp(1 - r / l) END) END AS b
      FROM prec JOIN lens ON lens.g = prec.g AND lens.d = prec.d)
    SELECT k.g AS {by}, count(bleu.b) AS n_docs, round(coalesce(avg(bleu.b), 0.0), 6) AS value
    FROM (SELECT DISTINCT g FROM toks) k LEFT JOIN bleu ON bleu.g = k.g GROUP BY k.g"""


@query("self_bleu_by_conversation", _bleu_sql("conversations", "conv_id", "turn"))
def self_bleu_by_conversation(spark, folder):
    turns = table(spark, folder, "conversations")
    return rounded(lexical.self_bleu(turns, ["conv_id"], "turn"), "value")


@query("self_bleu_by_source", _bleu_sql("documents", "source", "doc_id"))
def self_bleu_by_source(spark, folder):
    docs = table(spark, folder, "documents")
    return rounded(lexical.self_bleu(docs, ["source"], "doc_id"), "value")


@query(
    "closest_length_by_lang",
    f"""
    WITH docs AS (SELECT lang, doc_id, len({TOKENS}) AS len FROM documents)
    SELECT DISTINCT a.lang, a.len::INTEGER AS len, (SELECT b.len FROM docs b
        WHERE b.lang = a.lang AND b.doc_id <> a.doc_id
        ORDER BY abs(b.len - a.len), b.len LIMIT 1)::INTEGER AS ref_len
    FROM docs a""",
)
def closest_length_by_lang(spark, folder):
    docs = table(spark, folder, "documents")
    lengths = docs.select("lang", F.size(tx.tokens("text")).alias("len"))
    return lexical.closest_lengths(lengths, ["lang"])
