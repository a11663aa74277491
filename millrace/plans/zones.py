"""Zone maps: minimum, maximum and null count by partition and column, and which partitions a predicate can skip.

Spark's cache keeps such statistics by itself and prunes with them; these helpers show and test them.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def partition_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each partition: its number, rows, and min_, max_ and nulls_ of each column that has an order."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "binary", "void", "variant")]
    aggs = [F.count("*").alias("rows")]
    for c in names:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}")]
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(*aggs)


def order_stats(df: DataFrame, column: str, position: str) -> DataFrame:
    """For a whole-number column in the order of `position`, by partition: ascending, descending, and the largest step."""
    w = Window.partitionBy("p").orderBy(position)
    step = df.select(F.spark_partition_id().alias("p"), column, position).withColumn("d", F.col(column) - F.lag(column).over(w))
    return step.groupBy(F.col("p").alias("partition")).agg(
        F.coalesce(F.bool_and(F.col("d") >= 0), F.lit(True)).alias("ascending"), F.coalesce(F.bool_and(F.col("d") <= 0), F.lit(True)).alias("descending"), F.coalesce(F.max(F.abs("d")), F.lit(0)).alias("max_step")
    )


@dataclass(frozen=True)
class Compare:
    """column op value."""

    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any_:
    parts: tuple


def may_match(stats: dict[str, Any], predicate) -> bool:
    """Whether a partition with these statistics (rows, min_c, max_c, nulls_c) can hold a row that `predicate` keeps.

    Anything that isn't understood, and columns without statistics or of other types, keep the partition. A partition
    without rows, or with nulls alone in a compared column, holds none.
    """
    if not stats["rows"]:
        return False
    if isinstance(predicate, All):
        return all(may_match(stats, p) for p in predicate.parts)
    if isinstance(predicate, Any_):
        return any(may_match(stats, p) for p in predicate.parts)
    if not isinstance(predicate, Compare) or f"min_{predicate.column}" not in stats:
        return True
    low, high, v = stats[f"min_{predicate.column}"], stats[f"max_{predicate.column}"], predicate.value
    if stats.get(f"nulls_{predicate.column}") == stats["rows"]:
        return False
    if v is None:
        return False
    if low is None or high is None:
        return True
    try:
        return {"=": lambda: low <= v <= high, "<": lambda: low < v, "<=": lambda: low <= v, ">": lambda: high > v, ">=": lambda: high >= v, "!=": lambda: not low == high == v}.get(predicate.op, lambda: True)()
    except TypeError:
        return True


def flip(op: str) -> str:
    """The operator of `value op column` once turned into `column op value`."""
    return {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
