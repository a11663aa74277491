"""Managed in-memory tables: chosen by property or name, durable underneath, recoverable.

A cached table is a Parquet table of the catalog, kept in memory by Spark's columnar cache. So its statistics, pruning
and column encodings are Spark's, and after a restart recover() caches it again from its files: nothing is recomputed.
"""

from __future__ import annotations

import re
from enum import Enum

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from millrace.plans.zones import partition_stats


class InvalidCacheMode(ValueError):
    """A cache property whose value names no mode."""


class CacheMode(Enum):
    """Where a table is kept: nowhere, in executors' memory, or off-heap and on disk."""

    NONE = "none"
    HEAP = "heap"
    TACHYON = "tachyon"

    @classmethod
    def of(cls, text: str | None) -> CacheMode:
        """From a property's value, in any case; true is heap, false and nothing are none."""
        name = (text or "none").strip().lower()
        name = {"true": "heap", "false": "none"}.get(name, name)
        try:
            return cls(name)
        except ValueError:
            raise InvalidCacheMode(f"no cache mode: {text}") from None


#: The storage-level names that the dialect takes, with its own spellings.
STORAGE_LEVELS = {
    "NONE": StorageLevel.NONE, "DISK_ONLY": StorageLevel.DISK_ONLY, "DISK_ONLY2": StorageLevel.DISK_ONLY_2, "DISK_ONLY_2": StorageLevel.DISK_ONLY_2,
    "MEMORY_ONLY": StorageLevel.MEMORY_ONLY, "MEMORY_ONLY_2": StorageLevel.MEMORY_ONLY_2, "MEMORY_ONLY_SER": StorageLevel.MEMORY_ONLY, "MEMORY_ONLY_SER2": StorageLevel.MEMORY_ONLY_2, "MEMORY_ONLY_SER_2": StorageLevel.MEMORY_ONLY_2,
    "MEMORY_AND_DISK": StorageLevel.MEMORY_AND_DISK, "MEMORY_AND_DISK_2": StorageLevel.MEMORY_AND_DISK_2, "MEMORY_AND_DISK_SER": StorageLevel.MEMORY_AND_DISK, "MEMORY_AND_DISK_SER_2": StorageLevel.MEMORY_AND_DISK_2, "OFF_HEAP": StorageLevel.OFF_HEAP,
}
DEFAULT_LEVEL = "MEMORY_AND_DISK"


def property_of(properties: dict[str, str], name: str) -> str | None:
    """The value of property `name`, in any case and under any prefix, as in my.cache for cache."""
    return next((v for k, v in properties.items() if f".{k.lower()}".endswith(f".{name.lower()}")), None)


#: The property under which a table's definition is kept for recovery.
DEFINITION = "cache.definition"


def storage_level(name: str | None) -> StorageLevel:
    """The level of a name in any case; none given: memory and disk."""
    key = (name or DEFAULT_LEVEL).upper()
    if key not in STORAGE_LEVELS:
        raise ValueError(f"no storage level: {name}")
    return STORAGE_LEVELS[key]


def mode_of(table: str, properties: dict[str, str], by_name: bool = True) -> CacheMode:
    """What a CREATE TABLE AS asks for: its property, or else, if `by_name`, the ending of the table's name."""
    if (asked := property_of(properties, "cache")) is not None:
        return CacheMode.of(asked)
    name = table.split(".")[-1].lower()
    if by_name and name.endswith("_cached"):
        return CacheMode.HEAP
    if by_name and name.endswith("_tachyon"):
        return CacheMode.TACHYON
    return CacheMode.NONE


class CachedTables:
    """The cached tables of a session, by lower-case name."""

    def __init__(self, spark: SparkSession):
        self.spark, self._modes = spark, {}

    def __contains__(self, table: str) -> bool:
        return self._key(table) in self._modes

    def names(self) -> list[str]:
        return sorted(self._modes)

    @staticmethod
    def _key(table: str) -> str:
        return table.replace("`", "").lower()

    def create(self, table: str, query: DataFrame, mode: CacheMode, level: str | None = None, definition: str = "") -> None:
        """Write `query` as a Parquet table and, unless mode is none, hold it in memory."""
        storage_level(level)
        properties = {"cache": mode.value, "cache.storageLevel": level or DEFAULT_LEVEL, DEFINITION: definition}
        query.write.format("parquet").saveAsTable(table)
        said = ", ".join(f"'{k}' = '{v.encode().hex() if k == DEFINITION else v}'" for k, v in properties.items())
        self.spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({said})")
        self.hold(table, mode, level)

    def hold(self, table: str, mode: CacheMode, level: str | None = None) -> None:
        """Keep an existing table in memory and fill the cache now."""
        if mode is CacheMode.NONE:
            return
        chosen = storage_level(level)
        if mode is CacheMode.TACHYON and not level:
            chosen = StorageLevel.DISK_ONLY  # where no off-heap memory is set up, local disks serve
        self._modes[self._key(table)] = (mode, level)
        if chosen == StorageLevel.NONE:
            return
        self.spark.catalog.cacheTable(table, chosen)
        self.spark.table(table).count()

    def insert(self, table: str, rows: DataFrame, overwrite: bool = False) -> None:
        """INSERT INTO or OVERWRITE: files first, then the cache, so a failure leaves the old table whole.

        An overwrite that reads its own table is staged in a second table, as files can't be replaced while read.
        """
        try:
            rows.write.insertInto(table, overwrite=overwrite)
        except AnalysisException as e:
            if not (e.getCondition() or "").startswith("UNSUPPORTED_OVERWRITE"):
                raise
            stage = f"{table}__stage"
            self.spark.sql(f"DROP TABLE IF EXISTS {stage}")
            rows.write.format("parquet").saveAsTable(stage)
            self.spark.table(stage).write.insertInto(table, overwrite=True)
            self.spark.sql(f"DROP TABLE {stage}")
        self.spark.catalog.refreshTable(table)
        mode, level = self._modes.get(self._key(table), (CacheMode.NONE, None))
        if mode is not CacheMode.NONE:
            if self.spark.catalog.isCached(table):
                self.spark.catalog.uncacheTable(table)
            self.hold(table, mode, level)

    def drop(self, table: str) -> None:
        """Forget the table and free its memory; the catalog's table stays."""
        if self._modes.pop(self._key(table), None) and self.spark.catalog.tableExists(table) and self.spark.catalog.isCached(table):
            self.spark.catalog.uncacheTable(table)

    def recover(self) -> list[str]:
        """Hold again every table of the current database that was created as cached; gives their names."""
        found = []
        for t in self.spark.catalog.listTables():
            if t.isTemporary:
                continue
            properties = {r.key.lower(): r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {t.name}").collect()}
            mode = CacheMode.of(properties.get("cache")) if "cache" in properties else CacheMode.NONE
            if mode is not CacheMode.NONE:
                level = properties.get("cache.storagelevel")
                self.hold(t.name, mode, None if mode is CacheMode.TACHYON and level == DEFAULT_LEVEL else level)
                found.append(t.name)
        return sorted(found)

    def definition(self, table: str) -> str:
        """The statement that created a cached table."""
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
        return next((bytes.fromhex(r.value).decode() for r in rows if r.key == DEFINITION), "")

    def stats(self, table: str) -> DataFrame:
        """Rows, minima, maxima and null counts by partition."""
        return partition_stats(self.spark.table(table))


_CTAS = re.compile(r"\s*CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?([`\w.]+)\s*(.*?)\bAS\s+(SELECT|WITH|FROM|\(|MAP|REDUCE)\b", re.I | re.S)
_PROPERTIES = re.compile(r"TBLPROPERTIES\s*\((.*?)\)\s*", re.I | re.S)
_PAIR = re.compile(r"""['"]([^'"]*)['"]\s*=\s*['"]([^'"]*)['"]""")


def parse_ctas(sql: str) -> tuple[str, dict[str, str], str, str, bool] | None:
    """(table, properties, query, other clauses, whether IF NOT EXISTS) of a CREATE TABLE AS; None for any other statement."""
    m = _CTAS.match(sql)
    if not m:
        return None
    own = _PROPERTIES.search(m[3])
    return m[2], dict(_PAIR.findall(own[1])) if own else {}, sql[m.start(4) :], _PROPERTIES.sub("", m[3]).strip(), bool(m[1])


_INSERT = re.compile(r"\bINSERT\s+(INTO|OVERWRITE)\s+(?:TABLE\s+)?([`\w.]+)", re.I)


def parse_inserts(sql: str) -> list[tuple[str, bool]]:
    """(table, whether OVERWRITE) of each INSERT of a statement; directories are left out."""
    return [(t, how.upper() == "OVERWRITE") for how, t in _INSERT.findall(sql) if t.upper() not in ("DIRECTORY", "LOCAL")]
