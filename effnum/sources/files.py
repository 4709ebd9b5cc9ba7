"""Benchmark files, score tables and result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPORA = T.ArrayType(
    T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("axis", T.StringType()),
            T.StructField("regime", T.StringType()),
            T.StructField("family", T.StringType()),
            T.StructField("target_level", T.StringType()),
            T.StructField("documents", T.ArrayType(T.StringType())),
            T.StructField("concept_labels", T.ArrayType(T.StringType())),
            T.StructField("n_documents", T.IntegerType()),
            T.StructField("true_diversity", T.DoubleType()),
            T.StructField("expected", T.MapType(T.StringType(), T.DoubleType())),
            T.StructField("rationale", T.StringType()),
        ]
    )
)
CONTRASTS = T.ArrayType(
    T.StructType(
        [
            T.StructField(f, T.StringType())
            for f in ("level", "kind", "greater", "lesser", "corpus", "greater_level", "lesser_level", "rationale")
        ]
    )
)


def _section(spark: SparkSession, path: str, name: str, kind: T.ArrayType) -> DataFrame:
    schema = T.StructType([T.StructField(name, kind)])
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return whole.select(F.explode(name).alias("_r")).select("_r.*")


def read_corpora(spark: SparkSession, path: str) -> DataFrame:
    """Corpus records of benchmark JSON files, one row per corpus."""
    return _section(spark, path, "corpora", CORPORA)


def read_contrasts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Contrasts between corpora, and checks within one corpus."""
    rows = _section(spark, path, "contrasts", CONTRASTS)
    inside = F.col("level") == "__within_corpus__"
    between = rows.where(~inside).select("level", "kind", "greater", "lesser", "rationale")
    return between, rows.where(inside).select("corpus", "greater_level", "lesser_level", "rationale")


def read_scored_csv(spark: SparkSession, pattern: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All CSV files of a pattern with ``domain``, the last two ``_`` parts of the
    file's name. Give a schema to avoid a pass over the data to infer one."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    stem = F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    domain = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "_")
    return reader.csv(pattern).withColumn("domain", domain)


def responses(df: DataFrame, id: Sequence[str], columns: Sequence[str] = tuple(f"resp_{k}" for k in range(5))) -> DataFrame:
    """``id..., doc_id, text``: one row per non-blank response column."""
    rows = df.select(*id, F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("doc_id", "text"))
    return rows.where(F.col("text").isNotNull() & (F.trim("text") != ""))


def write_results(df: DataFrame, path: str, format: str = "json", mode: str = "overwrite") -> None:
    """Write results; lists and maps stay nested."""
    if format not in ("json", "parquet", "orc"):
        raise ValueError(f"unknown format {format!r}")
    df.write.mode(mode).format(format).save(path)


def heat_map(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., i, row``: the similarity table of small groups as labelled rows, each a
    map from the other id to the similarity."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("j").cast("string"), "sim"))))
    return pairs.groupBy(*by, "i").agg(entries.alias("row"))
