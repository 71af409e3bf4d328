"""A Spark data source for tables of a SQLite file, read-only, in ranges of rowid.

Options: path, table, columns (comma-separated; only these are read), where (a condition that SQLite applies itself),
rows (per partition). ``require`` checks that a file has the tables and columns an adapter needs.
"""

from __future__ import annotations

import sqlite3

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TYPES = {"INTEGER": "long", "INT": "long", "BIGINT": "long", "REAL": "double", "TEXT": "string", "JSON": "string", "": "string"}


def _open(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=5)
    con.text_factory = lambda b: b.decode(errors="replace")
    return con


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def columns(path: str, table: str) -> dict[str, str]:
    con = _open(path)
    try:
        return {r[1]: _TYPES.get(r[2].upper(), "string") for r in con.execute(f"PRAGMA table_info({_name(table)})")}
    finally:
        con.close()


def require(path: str, needed: dict[str, list[str]]) -> list[str]:
    """What of the needed tables and columns a file lacks."""
    return [f"{t}.{c}" for t, cs in needed.items() for have in [columns(path, t)] for c in cs if c not in have]


def populated(path: str, table: str) -> bool:
    con = _open(path)
    try:
        return bool(columns(path, table)) and con.execute(f"SELECT 1 FROM {_name(table)} LIMIT 1").fetchone() is not None
    finally:
        con.close()


def indexes(path: str, table: str) -> list[tuple[str, ...]]:
    """The columns of each index of a table, in their order."""
    con = _open(path)
    try:
        names = [r[1] for r in con.execute(f"PRAGMA index_list({_name(table)})")]
        return [tuple(r[2] for r in sorted(con.execute(f"PRAGMA index_info({_name(n)})"))) for n in names]
    finally:
        con.close()


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(None)
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.where, self.rows = options["path"], options["table"], options.get("where", "1"), int(options.get("rows", 200_000))
        self.fields = [(f.name, f.dataType.typeName()) for f in schema.fields]

    def partitions(self):
        con = _open(self.path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        finally:
            con.close()
        return [Rows(a, min(high, a + self.rows - 1)) for a in range(low, high + 1, self.rows)] if low is not None else [Rows(1, 0)]

    def read(self, partition):
        to = {"long": lambda x: x if type(x) is int else None, "double": lambda x: float(x) if type(x) in (int, float) else None, "string": lambda x: None if x is None else str(x)}
        casts = [to[t] for _, t in self.fields]
        con = _open(self.path)
        try:
            for row in con.execute(f"SELECT {', '.join(_name(n) for n, _ in self.fields)} FROM {_name(self.table)} WHERE rowid BETWEEN ? AND ? AND ({self.where})", (partition.first, partition.last)):
                yield tuple(c(x) for c, x in zip(casts, row))
        finally:
            con.close()


class Sqlite(DataSource):
    @classmethod
    def name(cls):
        return "ledger_sqlite"

    def schema(self):
        have = columns(self.options["path"], self.options["table"])
        chosen = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else list(have)
        return ", ".join(f"`{c}` {have[c]}" for c in chosen)

    def reader(self, schema):
        return _Reader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Sqlite)
