"""Dialect functions as Column builders and as SQL functions of a session.

Everything here stays in the JVM: expressions over built-in functions, or SQL functions defined over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Aggregates of which Spark's short names mean the sample, the dialect's the whole population.
std = stddev = F.stddev_pop
variance = F.var_pop


def field(value: Column, *options: Column) -> Column:
    """The place, from 1, of `value` among `options`; 0 if it is null or none of them. Null options match nothing."""
    where = F.lit(0)
    for i in range(len(options), 0, -1):
        where = F.when(value == options[i - 1], F.lit(i)).otherwise(where)
    return where


def create_union(tag: Column, *values: Column) -> Column:
    """A tagged union as struct(tag, v0, v1, ...): the value of the tag's number, the others null."""
    return F.struct(tag.cast("int").alias("tag"), *[F.when(tag == i, v).alias(f"v{i}") for i, v in enumerate(values)])


def union_value(union: Column, number: int) -> Column:
    """The value that a create_union() struct holds if its tag is `number`; else null."""
    return F.when(union["tag"] == number, union[f"v{number}"])


_URL_PARTS = ("HOST", "PATH", "QUERY", "REF", "PROTOCOL", "AUTHORITY", "FILE", "USERINFO")


def parse_url_tuple(url: Column, *parts: str) -> list[Column]:
    """One column for each part: a URL part's name, or QUERY:key for one parameter. Bad URLs give nulls."""
    out = []
    for i, p in enumerate(parts):
        name, _, key = p.partition(":")
        if name not in _URL_PARTS:
            raise ValueError(f"not a part of a URL: {p}")
        out.append((F.try_parse_url(url, F.lit(name), F.lit(key)) if key else F.try_parse_url(url, F.lit(name))).alias(f"c{i}"))
    return out


def _wrap(c: Column) -> Column:
    """A long brought into the range of a signed 32-bit integer."""
    return F.pmod(c + (1 << 31), F.lit(1 << 32)) - (1 << 31)


def hive_hash(df: DataFrame, *names: str) -> Column:
    """The dialect's row hash of columns of `df`: 31 * h + hash(value) in wrapping 32-bit arithmetic, as its buckets use it.

    Strings hash over their bytes, whole numbers to themselves, booleans to 1 and 0; null is 0. Other types raise.
    """
    total = F.lit(0).cast("long")
    for name in names:
        kind = df.schema[name].dataType.typeName()
        if kind == "string":
            one = string_hash(F.col(name))
        elif kind in ("byte", "short", "integer", "long", "boolean"):
            one = integer_hash(F.col(name))
        else:
            raise ValueError(f"no dialect hash for {kind}")
        total = _wrap(total * 31 + one)
    return total.cast("int")


def string_hash(c: Column) -> Column:
    """31 * h + byte over the signed UTF-8 bytes of a string, wrapping at 32 bits; null: 0."""
    raw = F.hex(c.cast("string"))
    byte = lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    places = F.sequence(F.lit(0), F.octet_length(c.cast("string")) - 1)
    signed = lambda b: F.when(b > 127, b - 256).otherwise(b)
    total = F.aggregate(places, F.lit(0).cast("long"), lambda h, i: _wrap(h * 31 + signed(byte(i))))
    return F.when(c.isNull() | (F.octet_length(c.cast("string")) == 0), F.lit(0)).otherwise(total.cast("int"))


def integer_hash(c: Column) -> Column:
    """The value itself for up to 32 bits, both halves mixed for 64; null: 0."""
    wide = c.cast("long")
    return F.coalesce(_wrap(F.shiftrightunsigned(wide, 32).bitwiseXOR(wide).bitwiseAND(F.lit((1 << 32) - 1))), F.lit(0)).cast("int")


def bucket(hashed: Column, buckets: int) -> Column:
    """The bucket number, from 0, of a row hash."""
    return F.pmod(hashed.bitwiseAND(F.lit((1 << 31) - 1)), F.lit(buckets)).cast("int")


def ngrams(df: DataFrame, sentences: str, n: int, k: int) -> DataFrame:
    """(ngram array, estfrequency): the k most frequent n-grams of a column of array<array<string>>; ties by ngram.

    Counts are exact. Counting is a partial and a final hash aggregation, and only k rows leave it.
    """
    words = df.select(F.explode_outer(sentences).alias("s")).filter(F.size("s") >= n)
    grams = words.select(F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("s") - n), lambda i: F.slice("s", i + 1, n))).alias("ngram"))
    return grams.groupBy("ngram").agg(F.count("*").cast("double").alias("estfrequency")).orderBy(F.desc("estfrequency"), "ngram").limit(k)


def context_ngrams(df: DataFrame, sentences: str, context: list[str | None], k: int) -> DataFrame:
    """(ngram array, estfrequency): the k most frequent fillings of the nulls in `context`; ties by ngram."""
    n = len(context)
    words = df.select(F.explode_outer(sentences).alias("s")).filter(F.size("s") >= n)
    seen = words.select(F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("s") - n), lambda i: F.slice("s", i + 1, n))).alias("g"))
    for i, word in enumerate(context):
        if word is not None:
            seen = seen.filter(F.col("g")[i] == word)
    free = F.array(*[F.col("g")[i] for i, word in enumerate(context) if word is None])
    return seen.select(free.alias("ngram")).groupBy("ngram").agg(F.count("*").cast("double").alias("estfrequency")).orderBy(F.desc("estfrequency"), "ngram").limit(k)


def register(spark: SparkSession) -> None:
    """Define the dialect's functions that fixed argument types allow, as temporary SQL functions over built-in ones."""
    for head, kind, body in (
        ("field3(x STRING, a STRING, b STRING, c STRING)", "INT", "CASE x WHEN a THEN 1 WHEN b THEN 2 WHEN c THEN 3 ELSE 0 END"),
        ("field_of(x STRING, options ARRAY<STRING>)", "INT", "CAST(coalesce(array_position(options, x), 0) AS INT)"),
        ("url_part(url STRING, part STRING)", "STRING", "try_parse_url(url, part)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
