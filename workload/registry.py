"""Where queries and their SQL definitions are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effnum.sources.corpus import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function ``(spark, folder) -> DataFrame`` under ``name``."""

    def add(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def r6(value: str | Column) -> Column:
    """Rounded to six places; comparisons are by value."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, r6(n))
    return df
