"""The session: SQL of the dialect in, rows, text or DataFrames out."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from millrace.functions.compat import register
from millrace.plans import dialect, render
from millrace.plans.cache import CachedTables, CacheMode, mode_of, parse_ctas, parse_inserts, property_of


class QueryExecutionError(RuntimeError):
    """A statement that can't be analysed or fails while it runs."""


def build_session(app: str = "millrace", master: str | None = None, hive: bool = False, **conf: str) -> SparkSession:
    """A Spark session with the dialect's semantics: null instead of errors, UTC, adaptive plans.

    `hive` adds a metastore and the SerDe formats (delimited text tables, SequenceFile, RCFile).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    own = {
        "spark.sql.ansi.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false", "spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.parser.quotedRegexColumnNames": "true", "spark.sql.legacy.sizeOfNull": "true",
    }
    for k, v in {**own, **conf}.items():
        builder = builder.config(k, v)
    if hive:
        builder = builder.config("spark.sql.legacy.createHiveTableByDefault", "true").enableHiveSupport()
    return builder.getOrCreate()


@dataclass
class Warehouse:
    """SQL over one Spark session, with cached tables and session variables."""

    spark: SparkSession
    #: Whether names that end in _cached or _tachyon ask for a cached table.
    cache_by_name: bool = True
    variables: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.cached = CachedTables(self.spark)
        register(self.spark)

    def sql(self, command: str, max_rows: int = 1000) -> list[str]:
        """Run one statement; up to `max_rows` result rows as tab-joined text."""
        return [render.line(r) for r in self._rows(self.sql_to_df(command).limit(max_rows))]

    def _rows(self, df: DataFrame):
        try:
            return df.collect()
        except PySparkException as e:
            raise QueryExecutionError(str(e).splitlines()[0]) from e

    def rows(self, df: DataFrame):
        """The rows of `df` one by one, of which the driver holds a partition at a time."""
        try:
            yield from df.toLocalIterator()
        except PySparkException as e:
            raise QueryExecutionError(str(e).splitlines()[0]) from e

    def sql_to_df(self, command: str) -> DataFrame:
        """Run one statement; a query is returned unevaluated, anything else has taken effect."""
        text = command.strip().rstrip(";")
        try:
            return self._run(text)
        except PySparkException as e:
            raise QueryExecutionError(str(e).splitlines()[0]) from e

    def sql_to_console(self, command: str, max_rows: int = 1000) -> None:
        """Run one statement and print its rows as a table."""
        self.sql_to_df(command).show(max_rows, truncate=False)

    def script(self, text: str, max_rows: int = 1000) -> list[str]:
        """Run the statements of a script; all result rows."""
        return [line for s in dialect.statements(text) for line in self.sql(s, max_rows)]

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "result string")

    def _run(self, text: str) -> DataFrame:
        if m := re.match(r"SET\s+(?:hiveconf:|hivevar:)?([\w.]+)\s*=\s*(.*)$", text, re.I | re.S):
            self.variables[m[1]] = m[2].strip()
            if f".{m[1].lower()}".endswith((".cache.flag.checktablename", ".cache.byname")):
                self.cache_by_name = m[2].strip().lower() == "true"
            if not m[1].startswith("spark."):
                return self._empty()
        sql = dialect.translate(text, self.variables)
        if self.spark.conf.get("spark.sql.catalogImplementation", "in-memory") != "hive":
            try:
                sql = dialect.storage(sql)
            except ValueError as e:
                raise QueryExecutionError(str(e)) from e
        if ctas := parse_ctas(sql):
            return self._create(text, sql, *ctas)
        targets = parse_inserts(sql)
        held = [t for t, _ in targets if t in self.cached]
        if held and len(targets) > 1:
            raise QueryExecutionError(f"an INSERT into several tables can't write the cached table {held[0]}")
        if held and not re.search(r"\bPARTITION\s*\(", sql, re.I):
            table, overwrite = targets[0]
            query = re.sub(r"\bINSERT\s+(INTO|OVERWRITE)\s+(TABLE\s+)?[`\w.]+", "", sql, count=1, flags=re.I)
            self.cached.insert(table, self.spark.sql(query), overwrite)
            return self._empty()
        if m := re.match(r"DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?([`\w.]+)", sql, re.I):
            self.cached.drop(m[1])
        if m := re.match(r"(?:LOAD\s+DATA)\s+(?:LOCAL\s+)?INPATH\s+['\"]([^'\"]+)['\"]\s+(OVERWRITE\s+)?INTO\s+TABLE\s+([`\w.]+)\s*$", sql, re.I):
            return self._load(m[1], bool(m[2]), m[3], sql)
        return self.spark.sql(sql)

    def _create(self, text: str, sql: str, table: str, properties: dict[str, str], query: str, clauses: str, keep: bool) -> DataFrame:
        """CREATE TABLE AS: Spark's own with all its clauses; a cached table takes no clauses but its properties."""
        if keep and self.spark.catalog.tableExists(table):
            return self._empty()
        mode = mode_of(table, properties, self.cache_by_name)
        level = property_of(properties, "cache.storageLevel")
        if mode is CacheMode.NONE:
            self.spark.sql(sql)
            return self._empty()
        if clauses and clauses.lower() != "using parquet":
            raise QueryExecutionError(f"a cached table can't have {clauses}")
        self.cached.create(table, self.spark.sql(query), mode, level, text)
        return self._empty()

    def _load(self, path: str, overwrite: bool, table: str, sql: str) -> DataFrame:
        """LOAD DATA: Spark's own for SerDe tables; for others the text is read by the table's schema and delimiters."""
        from millrace.sources.readers import DELIMITERS, read_text_table

        detail = {r.col_name.strip(): r.data_type for r in self.spark.sql(f"DESCRIBE FORMATTED {table}").collect()}
        if detail.get("Provider", "").lower() == "hive":
            return self.spark.sql(sql)
        properties = {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
        nested = (properties.get("collection.delim", DELIMITERS[1]), properties.get("mapkey.delim", DELIMITERS[2]), *DELIMITERS[3:])
        rows = read_text_table(self.spark, path, self.spark.table(table).schema, properties.get("field.delim", DELIMITERS[0]), nested)
        self.cached.insert(table, rows, overwrite)
        return self._empty()
