"""Table readers: delimited text with nested types, manifests of paths, mixed formats, fixed-size records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The dialect's default delimiters by nesting level, and its text for null.
DELIMITERS = ("\x01", "\x02", "\x03", "\x04", "\x05", "\x06", "\x07", "\x08")
NULL = "\\N"


def _quoted(delimiter: str) -> str:
    return "[" + ("\\" if delimiter in "\\]^[-" else "") + delimiter + "]"


def _typed(c: Column, kind: T.DataType, level: int, delimiters: tuple[str, ...], null: str) -> Column:
    """A delimited string as a value of `kind`. What can't be read is null, as the dialect has it."""
    text = F.when(c != null, c)
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.ArrayType):
        parts = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, _quoted(delimiters[level]), -1))
        return F.transform(parts, lambda x: _typed(x, kind.elementType, level + 1, delimiters, null))
    if isinstance(kind, T.MapType):
        pairs = F.filter(F.split(text, _quoted(delimiters[level]), -1), lambda x: x != "")
        key = lambda x: F.substring_index(x, delimiters[level + 1], 1)
        value = lambda x: F.when(F.instr(x, delimiters[level + 1]) > 0, F.substr(x, F.instr(x, delimiters[level + 1]) + 1))
        entry = F.transform(pairs, lambda x: F.struct(_typed(key(x), kind.keyType, level + 2, delimiters, null).alias("key"), _typed(value(x), kind.valueType, level + 2, delimiters, null).alias("value")))
        return F.map_from_entries(entry)
    if isinstance(kind, T.StructType):
        parts = F.split(text, _quoted(delimiters[level]), -1)
        return F.when(text.isNotNull(), F.struct(*[_typed(F.get(parts, F.lit(i)), f.dataType, level + 1, delimiters, null).alias(f.name) for i, f in enumerate(kind.fields)]))
    if isinstance(kind, T.BinaryType):
        return text.cast("binary")
    return F.trim(text).try_cast(kind)


def read_text_table(spark: SparkSession, path, schema: T.StructType | str, field: str = DELIMITERS[0], nested: tuple[str, ...] = DELIMITERS[1:], null: str = NULL) -> DataFrame:
    """A table of delimited text lines. Missing fields, and fields of another type, are null; surplus ones are ignored."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return _parsed(spark.read.text(path), schema, field, nested, null)


def _parsed(lines: DataFrame, schema: T.StructType, field: str, nested: tuple[str, ...], null: str) -> DataFrame:
    parts = lines.select(F.split("value", _quoted(field), -1).alias("f"))
    return parts.select(*[_typed(F.get("f", F.lit(i)), c.dataType, 0, nested, null).alias(c.name) for i, c in enumerate(schema.fields)])


def read_sequence(spark: SparkSession, path: str, schema: T.StructType | str, field: str = DELIMITERS[0], nested: tuple[str, ...] = DELIMITERS[1:], null: str = NULL) -> DataFrame:
    """SequenceFiles whose values are delimited lines, read as read_text_table() reads text; keys are ignored, as in the
    dialect. DataFrames have no reader of the format, so Hadoop's hands the values over."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    pairs = spark.sparkContext.sequenceFile(path, "org.apache.hadoop.io.Writable", "org.apache.hadoop.io.Text")
    return _parsed(spark.createDataFrame(pairs.map(lambda kv: (kv[1],)), "value string"), schema, field, nested, null)


def _said(c: Column, kind: T.DataType, level: int, delimiters: tuple[str, ...], null: str) -> Column:
    if isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(c, lambda x: _said(x, kind.elementType, level + 1, delimiters, null)), delimiters[level])
    elif isinstance(kind, T.MapType):
        text = F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(_said(e["key"], kind.keyType, level + 2, delimiters, null), F.lit(delimiters[level + 1]), _said(e["value"], kind.valueType, level + 2, delimiters, null))), delimiters[level])
    elif isinstance(kind, T.StructType):
        text = F.concat_ws(delimiters[level], *[_said(c[f.name], f.dataType, level + 1, delimiters, null) for f in kind.fields])
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit(null)).otherwise(text)


def text_lines(df: DataFrame, field: str = DELIMITERS[0], nested: tuple[str, ...] = DELIMITERS[1:], null: str = NULL) -> DataFrame:
    """One column `value` of delimited lines, as read_text_table() reads them back."""
    return df.select(F.concat_ws(field, *[_said(F.col(f"`{f.name}`"), f.dataType, 0, nested, null) for f in df.schema.fields]).alias("value"))


def read_manifest(spark: SparkSession, manifest, read=None) -> DataFrame:
    """The files that the lines of text files at `manifest` name. A manifest is a list of paths, short next to its data."""
    paths = [r.value.strip() for r in spark.read.text(manifest).filter(F.trim("value") != "").collect()]
    if not paths:
        return spark.createDataFrame([], "value string")
    return (read or spark.read.text)(paths)


def read_mixed(spark: SparkSession, partitions: list[tuple[dict[str, str], str, str]], schema: str) -> DataFrame:
    """A partitioned table whose partitions differ in format: (partition values, format, path) each, one schema for all.

    Partition values become string columns, as in the dialect; a column that a partition's files lack is null there.
    """
    kind, parts = T._parse_datatype_string(schema), []
    for values, fmt, path in partitions:
        df = read_text_table(spark, path, kind) if fmt == "text" else spark.read.format(fmt).load(path)
        have = {c.lower(): c for c in df.columns}
        cols = [(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields]
        parts.append(df.select(*cols, *[F.lit(v).alias(k) for k, v in values.items()]))
    if not parts:
        return spark.createDataFrame([], kind)
    return reduce(DataFrame.unionByName, parts)


def read_fixed_records(spark: SparkSession, path: str, size: int = 1000) -> DataFrame:
    """One binary column `record`: files cut into records of `size` bytes; a shorter rest at the end is a record too.

    A task holds a whole file, which Spark limits to 2 GB (`spark.sql.sources.binaryFile.maxLength` sets less).
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    count = F.ceil(F.length("content") / F.lit(size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("content"), i * size + 1, F.lit(size)))
    return files.filter(F.length("content") > 0).select("path", F.posexplode(cut).alias("number", "record"))


def sample_bucket(df: DataFrame, bucket: int, buckets: int, hashed: Column) -> DataFrame:
    """TABLESAMPLE (BUCKET bucket OUT OF buckets ON ...): rows whose hash falls into the bucket, numbered from 1."""
    return df.filter(F.pmod(hashed.bitwiseAND(F.lit((1 << 31) - 1)), F.lit(buckets)) == bucket - 1)
