"""Tables of SQLite files by a Python data source: read in ranges of row numbers, column types kept; one task writes.

A file stands in a folder that driver and executors share: SQLite opens local paths only. The driver asks for the columns
and the least and greatest row number; a partition reads a range of them. Tables without row numbers, and views, are one
partition.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 10_000
#: Declared types by what their names hold, in this order; a column without a declared type is text.
AFFINITY = (("INT", "long"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BOOL", "long"), ("NUM", "double"), ("DEC", "double"))
ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
DECLARED = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "boolean": "INTEGER", "float": "REAL", "double": "REAL", "string": "TEXT", "binary": "BLOB"}


def local_path(path: str) -> str:
    at = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in at:
        raise ValueError(f"SQLite opens local paths only: {path}")
    return at


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(path: str) -> sqlite3.Connection:
    """For reading; a file that is not there is an error and not made."""
    at = local_path(path)
    if not os.path.isfile(at):
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{at.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def kind_of(declared: str) -> str:
    return next((kind for part, kind in AFFINITY if part in declared.upper()), "string")


def columns_of(path: str, table: str) -> list[tuple[str, str]]:
    """(name, Spark type) of a table's columns."""
    db = _opened(path)
    try:
        found = db.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    finally:
        db.close()
    if not found:
        raise ValueError(f"no such table: {table}")
    return [(r[1], kind_of(r[2] or "")) for r in found]


@dataclass
class Rows(InputPartition):
    """Row numbers [first, last], or all rows."""

    first: int | None = None
    last: int | None = None


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", "8"))
        self.columns = columns_of(self.path, self.table)

    def partitions(self) -> list[Rows]:
        db = _opened(self.path)
        try:
            lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a view, or a table WITHOUT ROWID
            return [Rows()]
        finally:
            db.close()
        if lo is None:
            return [Rows()]
        if not isinstance(lo, int):  # a view's rowid is null or a column of that name
            return [Rows()]
        step = -(-(hi - lo + 1) // self.parts)
        return [Rows(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*self.columns, strict=True)
        # values are cast as the columns are declared: SQLite itself lets a row hold anything
        cast = {"long": "INTEGER", "double": "REAL", "string": "TEXT", "binary": "BLOB"}
        asked = ", ".join(f"CAST({quoted(n)} AS {cast[k]})" for n, k in self.columns)
        where = "" if partition.first is None else f" WHERE rowid BETWEEN {partition.first} AND {partition.last}"
        db = _opened(self.path)
        try:
            rows = db.execute(f"SELECT {asked} FROM {quoted(self.table)}{where}")
            while batch := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(zip(*batch, strict=True), kinds, strict=True)], names=list(names))
        finally:
            db.close()


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")``. Options: path, table, partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in columns_of(self.options["path"], self.options["table"]))

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(dict(self.options))


def sqlite_scan(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """All rows of a table."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").options(path=path, table=table, partitions=str(partitions)).load()


def sqlite_query(spark: SparkSession, path: str, sql: str, partitions: int = 8) -> DataFrame:
    """A query in Spark's SQL over a file's tables, under their own names; each is read as sqlite_scan reads it."""
    for name in sqlite_tables(path):
        if name.lower() in sql.lower():
            sqlite_scan(spark, path, name, partitions).createOrReplaceTempView(name)
    return spark.sql(sql)


def _names(path: str, kind: str) -> list[str]:
    db = _opened(path)
    try:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = ? ORDER BY name", (kind,))]
    finally:
        db.close()


def sqlite_tables(path: str) -> list[str]:
    return _names(path, "table")


def sqlite_indices(path: str) -> list[str]:
    return _names(path, "index")


def write_sqlite(df: DataFrame, path: str, table: str, index: list[str] | None = None) -> int:
    """Writes a table of flat columns to a new file, with an index on some of them; returns the number of rows. One task
    writes, batch by batch, as one file takes one writer; the file gets its name when it is whole."""
    kinds = dict(df.dtypes)
    wrong = [c for c, k in kinds.items() if k not in DECLARED]
    if wrong:
        raise TypeError(f"no SQLite type for {wrong}")
    at, names = local_path(path), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.makedirs(os.path.dirname(at) or ".", exist_ok=True)
        task = TaskContext.get()
        begun, n = f"{at}.{task.taskAttemptId() if task else 'driver'}", 0
        if os.path.exists(begun):
            os.remove(begun)
        db = sqlite3.connect(begun)
        db.execute(f"CREATE TABLE {quoted(table)} ({', '.join(f'{quoted(c)} {DECLARED[k]}' for c, k in kinds.items())})")
        for b in batches:
            db.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(names))})", zip(*[c.to_pylist() for c in b.columns], strict=True))
            n += b.num_rows
        if index:
            db.execute(f"CREATE INDEX {quoted(table + '_' + '_'.join(index))} ON {quoted(table)} ({', '.join(map(quoted, index))})")
        db.commit()
        db.close()
        os.replace(begun, at)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    done = df.repartition(1).mapInArrow(run, "n long").collect()
    if not done:  # a plan that is known to be empty has no task
        list(run(iter([])))
    return done[0]["n"] if done else 0
