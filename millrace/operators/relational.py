"""Relational operators as compositions of DataFrame calls, shaped for large and skewed inputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_by(df: DataFrame, *order: Column | str, distribute: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """SORT BY, with DISTRIBUTE BY if `distribute` is given: rows dealt by hash, then sorted within each partition."""
    dealt = (df.repartition(parts, *distribute) if parts else df.repartition(*distribute)) if distribute else df
    return dealt.sortWithinPartitions(*order)


def cluster_by(df: DataFrame, *cols: str, parts: int | None = None) -> DataFrame:
    """CLUSTER BY: distributed and sorted by the same columns."""
    return sort_by(df, *cols, distribute=cols, parts=parts)


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """ORDER BY ... LIMIT k: the least k of each partition, then of those; nothing else is shuffled."""
    return df.orderBy(*order).limit(max(k, 0))


def top_k_by_partition(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """SORT BY ... LIMIT k of each partition. Partitions stay where they are: a window over the partition number needs
    no more than each partition's own rows, and its group limit keeps k of them before anything moves."""
    part = df.withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(*order)
    return part.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_part", "_rank")


def equi_join(left: DataFrame, right: DataFrame, keys: Sequence[str | tuple[str, str]], how: str = "inner", null_safe: Sequence[bool] = (), residual: Column | None = None) -> DataFrame:
    """A join on pairs of columns, each null-safe if so flagged, with any further condition part of the join itself."""
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    safe = [*null_safe, *[False] * (len(pairs) - len(null_safe))]
    tests = [left[a].eqNullSafe(right[b]) if s else left[a] == right[b] for (a, b), s in zip(pairs, safe)]
    return left.join(right, reduce(lambda x, y: x & y, [*tests, *([residual] if residual is not None else [])]), how)


def join_broadcast(big: DataFrame, small: DataFrame, on, how: str = "inner", most_rows: int = 1_000_000) -> DataFrame:
    """A map-side join if the small side, counted up to the bound, has at most `most_rows` rows; else a shuffled one."""
    fits = small.limit(most_rows + 1).count() <= most_rows
    return big.join(F.broadcast(small) if fits else small, on, how)


def join_salted(left: DataFrame, right: DataFrame, key: str, salts: int = 16, hot_share: float = 0.001) -> DataFrame:
    """An inner join on one key for a left side with hot keys.

    Keys with `hot_share` or more of the left rows, of which there are at most 1 / hot_share, are dealt over `salts` by a
    hash of the whole row, and right rows of these keys alone are copied; all others are joined as they are. Null keys
    match nothing.
    """
    left, right = left.filter(F.col(key).isNotNull()), right.filter(F.col(key).isNotNull())
    least = max(1.0, left.count() * hot_share)
    hot = left.groupBy(key).count().filter(F.col("count") >= least).select(key, F.lit(True).alias("_hot"))
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def group_salted(df: DataFrame, keys: Sequence[str], sums: dict[str, str], salts: int = 16) -> DataFrame:
    """Sums by key in two steps, for keys so hot that even their partial sums meet in one task: {name: column}."""
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = spread.groupBy(*keys, "_salt").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return first.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])


def union_widen(*parts: DataFrame) -> DataFrame:
    """UNION ALL by position, named after the first; column types widen to a common one."""
    return reduce(DataFrame.union, parts)


def transform_script(df: DataFrame, columns: Sequence[str], command: str, schema: str) -> DataFrame:
    """SELECT TRANSFORM(columns) USING command AS (schema): tab-separated rows through a process in each task."""
    return df.sparkSession.sql(f"SELECT TRANSFORM({', '.join(columns)}) USING '{command}' AS ({schema}) FROM {{t}}", t=df)


def multi_group_by(df: DataFrame, keys: Sequence[str], aggregate: Column, name: str) -> DataFrame:
    """One aggregate by each key on its own, from a single reading: (key_name, key, name)."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key")) for k in keys])).alias("g"), "*")
    return rows.groupBy("g.key_name", "g.key").agg(aggregate.alias(name))


def flatten(df: DataFrame, column: str, name: str, outer: bool = False, position: str | None = None) -> DataFrame:
    """LATERAL VIEW (OUTER) [POS]EXPLODE of one column; without outer, rows with an empty or null array vanish."""
    if position:
        return df.select("*", (F.posexplode_outer if outer else F.posexplode)(column).alias(position, name))
    return df.select("*", (F.explode_outer if outer else F.explode)(column).alias(name))
