"""The two SQLite layouts: a cumulative store (sessions, counters by model, platform messages) and a message/part store.

Each read is projected to the columns that its adapter needs; columns that an older file lacks are null. ``probe`` tells
what a file lacks before anything is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqlite

_COUNTED = {**dict.fromkeys(("input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens"), "long"), "estimated_cost_usd": "double", "actual_cost_usd": "double", "cost_status": "string"}
_ROUTE = dict.fromkeys(("billing_provider", "billing_base_url", "billing_mode"), "string")
CUMULATIVE = {
    "sessions": {
        **dict.fromkeys(("id", "source", "chat_id", "thread_id", "parent_session_id", "model", "cwd", "git_repo_root"), "string"), **dict.fromkeys(("started_at", "ended_at", "last_activity_at"), "double"),
        **_ROUTE, **_COUNTED,
    },
    "session_model_usage": {**dict.fromkeys(("session_id", "model", "task"), "string"), "first_seen": "double", "last_seen": "double", **_ROUTE, **_COUNTED},
    "messages": {
        **dict.fromkeys(("session_id", "role", "platform_message_id", "display_kind"), "string"), **dict.fromkeys(("id", "observed", "active", "compacted", "_compressed_summary"), "long"), "timestamp": "double",
    },
}
MESSAGES = {
    "session": {"id": "string", "directory": "string", "parent_id": "string", "time_created": "long", "time_updated": "long"},
    "message": {"id": "string", "session_id": "string", "time_created": "long", "time_updated": "long", "data": "string"},
    "part": {"id": "string", "message_id": "string", "session_id": "string", "time_created": "long", "time_updated": "long", "data": "string"},
}
#: What a file must have to be read at all; for messages of a populated store also these leading index columns.
NEEDED = {"cumulative": {"sessions": ["id", "source", "started_at"]}, "messages": {t: list(c) for t, c in MESSAGES.items()}}
INDEXED = {"message": [("session_id", "time_created", "id")], "part": [("message_id", "id"), ("session_id",)]}


def probe(path: str, layout: str) -> list[str]:
    """What a file lacks of its layout: tables and columns, and for a populated message store indexes; empty if it can be read.

    A counter table by model must have its keys where it is there at all. A message store whose newer table alone is
    populated isn't supported.
    """
    lacks = sqlite.require(path, NEEDED[layout])
    if layout == "cumulative":
        return lacks + (sqlite.require(path, {"session_model_usage": ["session_id", "model"]}) if sqlite.columns(path, "session_model_usage") else [])
    if lacks:
        return lacks
    if not sqlite.populated(path, "message"):
        return ["message"] if sqlite.populated(path, "session_message") else []
    have = {t: sqlite.indexes(path, t) for t in INDEXED}
    return [f"{t}({', '.join(c)})" for t, needed in INDEXED.items() for c in needed if not any(i[: len(c)] == c for i in have[t])]


def read(spark: SparkSession, path: str, table: str, columns: dict[str, str], where: str = "1") -> DataFrame:
    """A table's columns as the layout has them; those that the file lacks are null, a missing table is empty. ``where`` is applied by SQLite."""
    sqlite.register(spark)
    have = sqlite.columns(path, table)
    some = [c for c in columns if c in have]
    if not some:
        return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns.items()))
    rows = spark.read.format("ledger_sqlite").options(path=path, table=table, where=where).schema(", ".join(f"`{c}` {columns[c]}" for c in some)).load()
    return rows.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def cumulative(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """The tables of all cumulative stores, each row with its ``path``."""
    out = {}
    for table, columns in CUMULATIVE.items():
        parts = [read(spark, p, table, columns).withColumn("path", F.lit(p)) for p in paths]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        out[table] = whole
    return out
