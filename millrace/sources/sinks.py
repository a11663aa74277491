"""Writers: directories, static and dynamic partitions, several sinks from one source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from millrace.sources.readers import text_lines


def write_directory(df: DataFrame, path: str, fmt: str = "text", overwrite: bool = True, compression: str | None = None) -> None:
    """INSERT (OVERWRITE) DIRECTORY: delimited text by default, or any format that Spark writes."""
    out = text_lines(df) if fmt == "text" else df
    writer = out.write.mode("overwrite" if overwrite else "append")
    (writer.option("compression", compression) if compression else writer).format(fmt).save(path)


def write_partitions(df: DataFrame, path: str, keys: list[str], overwrite: bool = True, fmt: str = "parquet") -> None:
    """INSERT with dynamic partitions: only the partitions that `df` has rows for are replaced.

    Rows are dealt by partition key first, with a rebalance that splits large keys, so files stay few and even.
    """
    even = df.hint("rebalance", *keys)
    even.write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).format(fmt).save(path)


def write_buckets(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """A table in files bucketed and sorted by `key`: one file a bucket, as rows are dealt by bucket before the write."""
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)


def write_sequence(df: DataFrame, path: str) -> None:
    """SequenceFiles of delimited values with null keys, which read_sequence() reads back."""
    classes = ("mapred.SequenceFileOutputFormat", "io.NullWritable", "io.Text")  # said, as an empty table has none to infer
    text_lines(df).rdd.map(lambda r: (None, r.value)).saveAsHadoopFile(path, *[f"org.apache.hadoop.{c}" for c in classes])


def multi_insert(source: DataFrame, sinks: list[tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], None]]]) -> None:
    """FROM source INSERT ... INSERT ...: each (query, write) of `sinks` from one reading of the source."""
    held = source.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for query, write in sinks:
            write(query(held))
    finally:
        held.unpersist()
