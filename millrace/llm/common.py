"""Helpers that the text operators share: table access, steps written to shared storage, and broadcasts of known size."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import fresh_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What lower-casing of A-Z alone changes, and to what.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Spark deletes the shuffle files of a query at its end where this is on.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that Spark hands to Python at once.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str, batch_rows: int = 0) -> DataFrame:
    """Write `df` to the shared folder and read it back: computed once, lineage cut, safe against lost executors.

    The write's own shuffle files are deleted at its end. `batch_rows`, if given, are handed to Python at once, which keeps
    the Arrow buffers of whole texts small on both sides.
    """
    spark = df.sparkSession
    wanted = {_CLEANUP: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
    path, before = fresh_path(spark, name), {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.mode("overwrite").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that materialize() gave and nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            drop_path(df.sparkSession, files[0].rsplit("/", 1)[0])


def packed(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` as its columns `own` and _rest, a struct of all others, so that none can clash with names added later, and
    what gives the columns of `docs` back."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kept, others = [c for c in docs.columns if c in own], [c for c in docs.columns if c not in own]
    rest = F.struct(*map(quoted, others)) if others else F.lit(None).cast("string")
    back = lambda df: df.select(*[F.col(c) if c in kept else F.col("_rest").getField(c).alias(c) for c in docs.columns])
    return docs.select(*kept, rest.alias("_rest")), back


def broadcast_if_small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Hint a broadcast only where the counted `rows` stay within `max_rows`; else Spark shuffles."""
    return F.broadcast(df) if rows <= max_rows else df.hint("merge")


def release_memory() -> None:
    """Give what Arrow and the C library keep for later back to the system, in a worker that lives on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
