"""The queries of this subpackage; each runs over its whole table."""

from __future__ import annotations

from . import bpe, forest, html_blocks, language, line_dedup, merkle, mixing, near_duplicates, quality_rules, topk_pivot, toxicity, url_trees, whitening
from .common import read

QUERIES = {
    "op1_topk_pivot": lambda spark, d: topk_pivot.digest(read(spark, d, "embeddings")),
    "op2_main_text": lambda spark, d: html_blocks.digest(read(spark, d, "pages")),
    "op3_bpe_round_trip": lambda spark, d: bpe.round_trip(read(spark, d, "documents"), bpe.vocabulary()),
    "op4_url_filter": lambda spark, d: url_trees.judge(read(spark, d, "pages")),
    "op5_jaccard_join": lambda spark, d: near_duplicates.digest(read(spark, d, "documents")),
    "op6_line_dedup": lambda spark, d: line_dedup.digest(read(spark, d, "documents")),
    "op7_mix_sources": lambda spark, d: mixing.digest(read(spark, d, "documents")),
    "op8_language_id": lambda spark, d: language.digest(read(spark, d, "documents")),
    "op9_forest_search": lambda spark, d: forest.digest(read(spark, d, "embeddings")),
    "op10_toxicity": lambda spark, d: toxicity.digest(read(spark, d, "documents"), read(spark, d, "labels")),
    "op11_whitening": lambda spark, d: whitening.digest(read(spark, d, "embeddings")),
    "op12_quality_rules": lambda spark, d: quality_rules.digest(read(spark, d, "documents")),
    "op13_merkle_manifest": lambda spark, d: merkle.digest(read(spark, d, "documents")),
}

SQL = {
    "op1_topk_pivot": topk_pivot.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_mix_sources": mixing.SQL,
    "op12_quality_rules": quality_rules.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
