"""SQLite tables as a Spark data source: reads cut by row number, writes in one transaction a task.

The file must be on storage that all machines share.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# What a declared column type means, by the parts of its name.
AFFINITIES = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BOOL", "boolean"))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.kinds = schema.names, [f.dataType.simpleString() for f in schema]
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("parts", "8"))

    def partitions(self) -> list[Rows]:
        with sqlite3.connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Rows(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        with sqlite3.connect(self.path) as db:
            names = ", ".join(map(quoted, self.names))
            for row in db.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)):
                yield tuple(bool(v) if k == "boolean" and v is not None else v for v, k in zip(row, self.kinds, strict=True))


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table, self.names = options["path"], options["table"], schema.names

    def write(self, rows: Iterator[Any]) -> WriterCommitMessage:
        names, marks = ", ".join(map(quoted, self.names)), ", ".join("?" * len(self.names))
        with sqlite3.connect(self.path, timeout=300) as db:  # a task that fails leaves nothing
            db.executemany(f"INSERT INTO {quoted(self.table)} ({names}) VALUES ({marks})", (tuple(r) for r in rows))
        return WriterCommitMessage()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_sqlite"

    def schema(self) -> str:
        with sqlite3.connect(self.options["path"]) as db:
            found = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']!r}")
        kinds = {name: next((k for part, k in AFFINITIES if part in (kind or "").upper()), "double") for _, name, kind, *_ in found}
        return ", ".join(f"`{n}` {k}" for n, k in kinds.items())

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite file, in parts by row number."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("quern_sqlite").option("path", path).option("table", table).option("parts", parts).load()


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    """Append rows to a table that is there; tasks write one after another."""
    df.sparkSession.dataSource.register(SqliteSource)
    df.write.format("quern_sqlite").option("path", path).option("table", table).mode("append").save()
