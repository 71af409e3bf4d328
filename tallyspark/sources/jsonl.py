"""A Spark data source for append-only JSON lines that may still be growing, for batch and for streams.

Only newline-terminated lines count; a carriage return before the newline goes, blank lines are skipped, a line over
``maxLineBytes`` or that isn't JSON is delivered as a gap. A stream's offset holds for each file the byte after its
last whole line with fingerprints of its first bytes and of those before the offset; a file that shrank or whose
fingerprints differ is read again from its start, and ``replay`` says why.

Columns: path, offset (of the line), line (null for a gap), gap (why, or null), replay (why the file began anew).
"""

from __future__ import annotations

import glob
import hashlib
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, line string, gap string, replay string"
MOST_LINE, EDGE, PART = 64 << 20, 4096, 64 << 20


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int, replay: str | None):
        super().__init__(None)
        self.path, self.start, self.end, self.replay = path, start, end, replay


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".jsonl"))
    return sorted(glob.glob(path))


def _bytes(path: str, start: int, n: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(start)
        return f.read(n)


def _whole_end(path: str) -> int:
    """The byte after the last newline."""
    at = os.path.getsize(path)
    while at > 0:
        start = max(0, at - (1 << 16))
        found = _bytes(path, start, at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


def cursor(path: str) -> dict:
    end = _whole_end(path)
    tail = max(0, end - EDGE)
    return {"end": end, "head": hashlib.sha256(_bytes(path, 0, min(EDGE, end))).hexdigest(), "tail": hashlib.sha256(_bytes(path, tail, end - tail)).hexdigest()}


def resumed(path: str, was: dict | None) -> tuple[int, str | None]:
    """Where to go on reading a file, and why from its start if so."""
    if was is None:
        return 0, "new"
    end = was["end"]
    if os.path.getsize(path) < end:
        return 0, "truncated"
    if hashlib.sha256(_bytes(path, 0, min(EDGE, end))).hexdigest() != was["head"]:
        return 0, "prefix"
    tail = max(0, end - EDGE)
    if hashlib.sha256(_bytes(path, tail, end - tail)).hexdigest() != was["tail"]:
        return 0, "tail"
    return end, None


def _pieces(path: str, start: int, end: int, replay: str | None) -> list[Piece]:
    return [Piece(path, a, min(end, a + PART), replay) for a in range(start, end, PART)]


def _next_line(f, most: int) -> tuple[bytes, int]:
    """The next line and its size; of one over ``most`` bytes only the last block is held."""
    raw = f.readline(most + 2)
    size = len(raw)
    while raw and not raw.endswith(b"\n"):
        raw = f.readline(1 << 16)
        size += len(raw)
    return raw, size


def _not_json(name: str):
    """NaN and Infinity, which Python's parser would take, are no JSON."""
    raise ValueError(name)


def _lines(p: Piece, most: int):
    """Lines that begin in a piece; the one that its end cuts belongs to it, the one before its start doesn't."""
    with open(p.path, "rb") as f:
        at = p.start
        if at and _bytes(p.path, at - 1, 1) != b"\n":
            f.seek(at)
            at += _next_line(f, most)[1]
        f.seek(at)
        while at < p.end:
            raw, size = _next_line(f, most)
            if not raw.endswith(b"\n"):
                return
            line = raw[:-1].removesuffix(b"\r")
            if line.strip() or size > most + 2:
                gap, text = None, None
                if size > most + 2 or len(line) > most:
                    gap = "oversize"
                else:
                    try:
                        text = line.decode()
                        json.loads(text, parse_constant=_not_json)
                    except ValueError:
                        gap, text = "parse-gap", None
                yield (p.path, at, text, gap, p.replay)
            at += size


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("maxLineBytes", MOST_LINE))

    def partitions(self):
        return [x for f in _files(self.path) for x in _pieces(f, 0, _whole_end(f), "new")] or [Piece("", 0, 0, None)]

    def read(self, partition):
        return _lines(partition, self.most) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("maxLineBytes", MOST_LINE))

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {f: json.dumps(cursor(f)) for f in _files(self.path)}

    def partitions(self, start, end):
        out = []
        for f, told in sorted(end.items()):
            was = json.loads(start[f]) if f in start else None
            if told == start.get(f):
                continue
            at, why = resumed(f, was)
            out += _pieces(f, at, json.loads(told)["end"], why)
        return out

    def read(self, partition):
        return _lines(partition, self.most)

    def commit(self, end):
        pass


class JsonLines(DataSource):
    @classmethod
    def name(cls):
        return "ledger_jsonl"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonLines)
