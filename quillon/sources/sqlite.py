"""SQLite files as a data source: executors read ranges of row numbers, the driver only the columns' names and the bounds.

Files must lie in a folder that the driver and all executors reach. ``spark.read.format("quillon_sqlite")`` takes the
options path, table, columns (comma-separated; all by default), where (an SQL condition, applied by SQLite), and rows
(of a partition at most, by row numbers).
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_BATCH = 8192


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kind_of(declared: str) -> str:
    """Spark's type for a declared one, by SQLite's rules of affinity; what has none or NUMERIC comes as double or string."""
    d = declared.upper()
    if "INT" in d or "BOOL" in d:
        return "long"
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "BLOB" in d:
        return "binary"
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return "double"
    return "string"


def _as(kind: str, value: object) -> object:
    """A value as its column's type; SQLite keeps any value in any column, and what can't be one becomes null."""
    if value is None:
        return None
    try:
        if kind == "long":
            return int(value)
        if kind == "double":
            return float(value)
        if kind == "binary":
            return value if isinstance(value, bytes) else str(value).encode()
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    except (TypeError, ValueError):
        return None


def columns_of(path: str, table: str) -> list[tuple[str, str]]:
    """Names and Spark types of a table's columns, in order; LookupError if there is no such table."""
    with _open(path) as db:
        found = [(r[1], kind_of(r[2] or "")) for r in db.execute(f"PRAGMA table_info({_quoted(table)})")]
    if not found:
        raise LookupError(f"{path} has no table {table}")
    return found


@dataclass
class RowRange(InputPartition):
    """Row numbers from ``first`` to ``last``; all rows if they are None, as for views and tables without row numbers."""

    first: int | None
    last: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table = options["path"], options["table"]
        self.where, self.rows = options.get("where"), int(options.get("rows", 100_000))
        self.names = [f.name for f in schema]
        self.kinds = [kind_of_spark(f.dataType.simpleString()) for f in schema]

    def partitions(self) -> list[RowRange]:
        with _open(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [RowRange(None, None)]
        if not isinstance(low, int) or not isinstance(high, int):
            return [RowRange(None, None)]
        return [RowRange(at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]

    def read(self, partition: RowRange) -> Iterator:
        import pyarrow as pa

        types = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
        conditions = [f"({self.where})"] if self.where else []
        values: tuple = ()
        if partition.first is not None:
            conditions, values = ["rowid BETWEEN ? AND ?", *conditions], (partition.first, partition.last)
        sql = f"SELECT {', '.join(map(_quoted, self.names)) or '1'} FROM {_quoted(self.table)}" + (" WHERE " + " AND ".join(conditions) if conditions else "")
        with _open(self.path) as db:
            db.text_factory = bytes  # damaged text is read too
            cursor = db.execute(sql, values)
            while rows := cursor.fetchmany(_BATCH):
                arrays = [pa.array([_as(k, r[i]) for r in rows], types[k]) for i, k in enumerate(self.kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=self.names)


def kind_of_spark(simple: str) -> str:
    return {"bigint": "long", "double": "double", "binary": "binary"}.get(simple, "string")


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_sqlite"

    def schema(self) -> str:
        found = columns_of(self.options["path"], self.options["table"])
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        kinds = dict(found)
        if unknown := set(wanted) - set(kinds):
            raise LookupError(f"no columns {sorted(unknown)}")
        return ", ".join(f"`{n.replace('`', '``')}` {kinds[n]}" for n in wanted or [n for n, _ in found])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)


def sqlite_table(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, where: str | None = None, rows: int = 100_000) -> DataFrame:
    """A table or view of an SQLite file, read on the executors in ranges of ``rows`` row numbers; only ``columns`` are read.

    Values that aren't of their column's declared type become null. An empty table has its columns.
    """
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("quillon_sqlite").option("path", path).option("table", table).option("rows", rows)
    if columns is not None:
        reader = reader.option("columns", ",".join(columns))
    if where is not None:
        reader = reader.option("where", where)
    return reader.load()
