"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. A window is
``WINDOW`` consecutive words of an item, or the whole of a shorter item. Every document streams its tokens through
the automaton, which gives the longest match that ends at each token: where it reaches the window, the last
``WINDOW`` words are hit, and the state tells the items; shorter items are found on the chain of suffix links.

The automaton goes to the executors by broadcast. Its size is bounded: ``MOST_WORDS`` words of items make one
automaton, longer items are split with an overlap that keeps every window, and further automata run in further
passes over the documents, which carry the hits found so far. Nothing is shuffled.

Null texts and items have no words. Items of equal id count once; an item of null id hits but isn't listed. An
empty benchmark hits nothing. Rows, repeated ones too, are handled one by one; other columns are ignored by the
digest and kept by ``remove``.

``remove`` cuts every hit span, those of items shorter than a window too, so an item of one word takes that word
out of all texts; ``long`` spares spans of fewer words. Very long texts are streamed whole; empty documents give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW, MOST_WORDS = 10, 100_000
#: A span of at least so many hit words is cut; a text with more than this share of hit words goes.
LONG, COVERED = 1, 0.5
_TO_WORDS = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


class Automaton:
    """All substrings of all items; ``items`` and ``short`` say which windows end at a state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next, self.link, self.long = [{}], [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        self.least = min((min(window, len(c)) for _, c in coded), default=0)
        for _, code in coded:
            last = 0
            for a in code:
                last = self._extend(last, a)
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for name, code in coded:
            state = 0
            for j, a in enumerate(code):
                state = self.next[state][a]
                if j + 1 >= window:
                    self.items.setdefault(self._cut(state), set()).add(name)
            if len(code) < window:
                self.short.setdefault(state, []).append((len(code), name))
        self.above = [-1] * len(self.next)  # the nearest state on the chain, itself included, where short items end
        for s in sorted(range(1, len(self.next)), key=self.long.__getitem__):
            self.above[s] = s if s in self.short else self.above[self.link[s]]

    def _new(self, long: int, to: dict, link: int) -> int:
        self.next.append(to)
        self.long.append(long)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, a: int) -> int:
        """The state of p's longest string followed by a, made if its class holds longer ones too."""
        q = self.next[p][a]
        if self.long[q] == self.long[p] + 1:
            return q
        clone = self._new(self.long[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(a) == q:
            self.next[p][a] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, a: int) -> int:
        if a in self.next[last]:
            return self._split(last, a)
        made = self._new(self.long[last] + 1, {}, 0)
        p = last
        while p >= 0 and a not in self.next[p]:
            self.next[p][a] = made
            p = self.link[p]
        self.link[made] = 0 if p < 0 else self._split(p, a)
        return made

    def _cut(self, state: int) -> int:
        while self.long[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Which words are hit (None: none), and by which items."""
        if not self.least or len(words) < self.least:
            return None, set()
        get = self.ids.get
        code = np.array([get(w, -1) for w in words], np.int64)
        known = np.concatenate([[0], (code >= 0).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(known))
        runs = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= self.least]
        hit, names = np.zeros(len(words), bool), set()
        for a, b in runs:
            self._stream(code[a:b].tolist(), hit[a:b], names)
        return (hit, names) if hit.any() else (None, names)

    def _stream(self, code: list[int], hit: np.ndarray, names: set) -> None:
        state = length = 0
        following, link, long, above = self.next, self.link, self.long, self.above
        for j, a in enumerate(code):
            while a not in following[state]:  # every known word follows the root
                state = link[state]
                length = long[state]
            state = following[state][a]
            length += 1
            if length >= self.window:
                hit[j + 1 - self.window : j + 1] = True
                names |= self.items[self._cut(state)]
            s = above[state]
            while s > 0:
                for n, name in self.short[s]:
                    if n <= length:
                        hit[j + 1 - n : j + 1] = True
                        names.add(name)
                s = above[link[s]]


def _chunks(items: DataFrame, window: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in lists of at most MOST_WORDS words, brought here one at a time."""
    held, n = [], 0
    for row in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = words_of(row[1])
        for a in range(0, max(1, len(words) - window + 1), MOST_WORDS // 2):
            part = words[a : a + MOST_WORDS // 2 + window - 1]
            if part:
                if n + len(part) > MOST_WORDS and held:
                    yield held
                    held, n = [], 0
                held.append((row[0], part))
                n += len(part)
    yield held


def _pass(automaton):
    def run(batches):
        own = automaton.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            bits, listed = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            hits, names = [], []
            for i in range(batch.num_rows):
                words = words_of(text[i].as_py())
                hit, found = own.scan(words)
                was = bits[i].as_py()
                if was is not None:
                    old = np.unpackbits(np.frombuffer(was, np.uint8), count=len(words)).astype(bool)
                    hit = old if hit is None else hit | old
                hits.append(None if hit is None else np.packbits(hit).tobytes())
                names.append(sorted({*found, *(listed[i].as_py() or [])} - {None}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string()))], schema=pa.schema([*list(batch.schema)[:-2], pa.field(batch.schema.names[-2], pa.binary()), pa.field(batch.schema.names[-1], pa.list_(pa.string()))]))

    return run


def _passed_on(automaton, then):
    found = _pass(automaton)
    return lambda batches: then(found(batches))


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, then: Callable | None = None, to: str | T.StructType | None = None) -> DataFrame:
    """``docs``'s columns with two more at their end: a bit for each word (null: none), and the sorted ids of the items found.

    Their names are ``_hits`` and ``_items``, longer ones where ``docs`` has these. ``then`` takes the batches of the last
    pass, within the same Python worker, and gives those of schema ``to``: a pass of its own would take a second worker a task.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    taken = {c.lower() for c in docs.columns}
    hits, listed = (next(n for k in range(len(taken) + 1) if (n := name + "_" * k) not in taken) for name in ("_hits", "_items"))
    out = docs.select("*", F.lit(None).cast("binary").alias(hits), F.array().cast("array<string>").alias(listed))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])
    last = None
    for chunk in _chunks(items, window):
        if last is not None:
            out = common.cut(out.mapInArrow(_pass(last), schema))
        last = spark.sparkContext.broadcast(Automaton(chunk, window))
    return out.mapInArrow(_passed_on(last, then), to) if then else out.mapInArrow(_pass(last), schema)


def _digest(batches):
    for batch in batches:
        text, bits, items = (batch.column(k) for k in (1, 2, 3))
        n, hit, sha = [], [], []
        for i in range(batch.num_rows):
            n.append(len(words_of(text[i].as_py())))
            was = bits[i].as_py()
            hit.append(0 if was is None else int(np.unpackbits(np.frombuffer(was, np.uint8)).sum()))
            sha.append(hashlib.sha256(",".join(items[i].as_py()).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document: its words, those inside windows of items, and the items."""
    return matched(docs.select("doc_id", "text"), items, window, _digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _cut_out(covered: float, long: int, names: list[str]):
    def clean(text: str, bits: bytes) -> str | None:
        raw = text.encode()
        spots = [m.span() for m in _WORD.finditer(raw.translate(_TO_WORDS))]
        hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(spots))
        if hit.sum() > covered * len(spots):
            return None
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        kept, at = [], 0
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= long:
                kept.append(raw[at : spots[a][0]])
                at = spots[b - 1][1]
        return b"".join([*kept, raw[at:]]).decode()

    def run(batches):
        for batch in batches:
            t = names.index("text")
            text, bits = batch.column(t), batch.column(batch.num_columns - 2)
            out = [x if (b := bits[i].as_py()) is None else clean(x, b) for i, x in enumerate(text.to_pylist())]
            keep = pa.array([x is not None or text[i].as_py() is None for i, x in enumerate(out)])
            done = batch.set_column(t, batch.schema.field(t), pa.array(out, text.type)).select(range(batch.num_columns - 2))
            yield done.filter(keep)

    return run


def remove(docs: DataFrame, items: DataFrame, window: int = WINDOW, long: int = LONG, covered: float = COVERED) -> DataFrame:
    """``docs`` without the hit spans of at least ``long`` words, and without texts hit in more than the share ``covered``."""
    return matched(docs, items, window, _cut_out(covered, long, docs.columns), T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents, letters),
t AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark, letters),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM t WHERE len(w) > 0)),
tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
ten AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM tok),
hit AS (
  SELECT DISTINCT ten.doc_id, ten.i, win.k, win.item_id
  FROM ten JOIN (SELECT DISTINCT k FROM win) ks ON len(ten.l) >= ks.k JOIN win ON win.k = ks.k AND win.s = array_to_string(list_slice(ten.l, 1, ks.k), ' ')),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
