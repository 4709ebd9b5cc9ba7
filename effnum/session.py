"""Session settings and the few helpers every operator shares."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name of the stand-in key used when an operator is called with ``by=[]``.
ALL = "_all"


def build_session(app: str = "effnum", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    Nothing here is sized to a machine: partition counts, memory and the
    checkpoint folder are left to the cluster's own configuration.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Checkpoints go once nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def constant(column: str) -> Column:
    """Zero for every row, in a form that Catalyst does not fold (as it does a literal
    or a product with zero)."""
    return F.pmod(F.hash(F.col(f"`{column}`")), F.lit(1))


def keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rename the grouping columns to ``_k0, _k1, ...`` so that they cannot clash with
    the operators' own columns, and return the new names.

    Without grouping columns a stand-in is added. It is computed from a column, not a
    literal: Catalyst would fold an equality of two literals and turn the join on it
    into a cross join.
    """
    if not by:
        return df.withColumn(ALL, constant(df.columns[0])), [ALL]
    names = {k: f"_k{i}" for i, k in enumerate(by)}
    return df.withColumnsRenamed(names), list(names.values())


def unkeyed(by: Sequence[str], df: DataFrame) -> DataFrame:
    """Give the grouping columns their names back, or drop the stand-in."""
    if not by:
        return df.drop(ALL)
    return df.withColumnsRenamed({f"_k{i}": k for i, k in enumerate(by)})


def partitions(df: DataFrame) -> int:
    """The session's shuffle partition count."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder.

    Used inside iterative operators, where the plan would otherwise grow with
    every step. Reliable checkpoints survive the loss of executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise RuntimeError(
                "iterative operators need a shared folder: set spark.checkpoint.dir"
            )
        context.setCheckpointDir(folder)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that all executors reach: ``spark.checkpoint.dir``."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("iterative operators need a shared folder: set spark.checkpoint.dir")
    return folder


class Scratch:
    """Intermediate tables in the shared folder, for steps too large to keep until the end.

    ``keep`` writes a DataFrame as Parquet and gives it back without its lineage, and ``drop`` deletes
    such a table once nothing will read it again. Unlike a checkpoint, a written table holds on
    to none of the shuffles it came from, so these are freed at once.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.tables: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.tables)}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.tables[id(table)])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Free the shuffles and checkpoints that nothing refers to any more, now.

    Spark frees them when the driver's JVM collects garbage, which a driver with little
    to do rarely does. Call it after a large step whose result has been written.
    """
    spark.range(1).count()  # until the next job, the scheduler still refers to the last one
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def stable_order(seed: int | str, *columns: str | Column) -> Column:
    """A reproducible pseudo-random sort key: md5 over the seed and the columns."""
    parts = [F.lit(str(seed))]
    parts += [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.md5(F.concat_ws(":", *parts))
