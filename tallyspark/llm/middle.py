"""Fill-in-middle: texts cut at two ranks into prefix, middle and suffix, and put together around sentinels.

One Aho-Corasick automaton finds all events of a text in one pass: the sentinels, and the ASCII characters that
change the class of what they stand in. Between two events lies a gap of one class, whose number of units is
arithmetic: a class of width w gives a unit for each w code points (the last may be shorter), a class without a
width is one unit a run. So a table of runs with cumulative counts, as sparse as the events, turns any rank into a
place by one binary search and a division; texts are never listed unit by unit.

``CODE_POINTS``, which op11 takes, gives every class the width 1: no character changes how units are counted then, so
the automaton holds the sentinels alone and a text without any is one run. ``WORDS`` counts runs of ASCII white space
and runs of anything else.

The ranks come from SHA-256 of ``1:`` and the decimal doc_id, so they don't depend on rows or partitions. A text that
is empty or null, holds a sentinel or has a hash beyond ``RATE`` stays plain. Rows, repeated ones too, are handled one
by one without a shuffle; a null doc_id hashes as the empty text; very long texts are cut whole; empty tables give no
rows. ``transform`` keeps all columns but those it sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many are transformed, and of a hundred transformed ones so many have the suffix first.
RATE, SPM = 90, 20
WHITE = " \t\n\x0b\f\r"
_SET = ("form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Units:
    """How code points make units: for each class its ASCII characters and its width (None: a run is one unit); ``rest`` is the width of all other characters."""

    classes: tuple[tuple[str, int | None], ...]
    rest: int | None

    def automaton(self) -> ahocorasick.Automaton:
        """Sentinels are events of class -1; so are the characters of those classes that are counted in another way than the rest."""
        found = ahocorasick.Automaton()
        for k, (chars, width) in enumerate(self.classes, 1):
            for c in chars if (width, self.rest) != (1, 1) else "":
                found.add_word(c, (k, 1))
        for s in SENTINELS:
            found.add_word(s, (-1, len(s)))
        found.make_automaton()
        return found


CODE_POINTS = Units(((WHITE, 1),), 1)
WORDS = Units(((WHITE, None),), None)


class Ranks:
    """Runs of one class in a text, with the units before each: ``place(r)`` is where the first r units end."""

    def __init__(self, text: str, units: Units, automaton: ahocorasick.Automaton):
        at, kinds, self.sentinels = [], [], []
        for last, (kind, long) in automaton.iter(text):
            if kind < 0:
                self.sentinels.append((last + 1 - long, text[last + 1 - long : last + 1]))
            else:
                at.append(last)
                kinds.append(kind)
        events, n = np.array(at, np.int64), len(text)
        # A run begins at each event that follows another class, and behind each event that no event follows.
        before = np.concatenate([[-1], events[:-1]]) if len(events) else events
        kind = np.array(kinds, np.int64)
        new = (events != before + 1) | (kind != np.concatenate([[0], kind[:-1]])) if len(events) else np.zeros(0, bool)
        gap = np.concatenate([events + 1, [0]])
        gap = gap[~np.isin(gap, events) & (gap < n)]
        starts, kind = np.concatenate([events[new], gap]), np.concatenate([kind[new], np.zeros(len(gap), np.int64)])
        order = np.argsort(starts, kind="stable")
        self.starts = starts[order]
        runs = np.diff(np.append(self.starts, n))
        widths = np.array([units.rest or 0, *[w or 0 for _, w in units.classes]], np.int64)[kind[order]]
        self.widths = np.where(widths, widths, np.maximum(runs, 1))
        self.before = np.concatenate([[0], np.cumsum(-(-runs // self.widths))])
        self.n, self.count = n, int(self.before[-1])

    def place(self, rank: int) -> int:
        if rank >= self.count:
            return self.n
        run = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.starts[run] + self.widths[run] * (rank - self.before[run]))


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    told = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(told[k : k + 8], 16) for k in (0, 8, 16, 24))


def cut(text: str, doc_id: int | None, units: Units, automaton: ahocorasick.Automaton, rate: int = RATE, spm: int = SPM) -> tuple[str, int | None, int | None, str]:
    """(form, code points of prefix and middle, output) of one text."""
    h1, h2, h3, h4 = draws(doc_id)
    if not text or h3 % 100 >= rate:
        return "plain", None, None, text
    ranks = Ranks(text, units, automaton)
    if ranks.sentinels:
        return "plain", None, None, text
    a, b = sorted((ranks.place(h1 % (ranks.count + 1)), ranks.place(h2 % (ranks.count + 1))))
    if h4 % 100 < spm:
        return "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def rebuilt(output: str, form: str, automaton: ahocorasick.Automaton) -> str:
    """The text of an output: the parts between its three sentinels, in their first order."""
    if form == "plain":
        return output
    found = [(last - 2, output[last - 2 : last + 1]) for last, (kind, _) in automaton.iter(output) if kind < 0]
    ends = [at for at, _ in found[1:]] + [len(output)]
    parts = {name: output[at + 3 : end] for (at, name), end in zip(found, ends)}
    if [name for _, name in found] != list(SENTINELS if form == "psm" else (SUFFIX, PREFIX, MIDDLE)) or found[0][0]:
        raise ValueError("not an output of this form")
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]


def transform(docs: DataFrame, units: Units = CODE_POINTS, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` with ``form``, ``prefix_chars``, ``middle_chars`` (null where plain) and ``output``."""
    common.prepare(docs.sparkSession)
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in _SET])
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = units.automaton()
        for batch in batches:
            ids, texts = batch.column(names.index("doc_id")).to_pylist(), batch.column(names.index("text"))
            form, prefix, middle, output = zip(*(cut(t.as_py() or "", d, units, automaton, rate, spm) for d, t in zip(ids, texts))) if batch.num_rows else ((),) * 4
            columns = [pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *_SET])

    added = [T.StructField(c, t) for c, t in zip(_SET, (T.StringType(), T.LongType(), T.LongType(), T.StringType()))]
    return rest.mapInArrow(run, T.StructType([*[T.StructField(f.name, f.dataType) for f in rest.schema], *added]))


def restore(done: DataFrame) -> DataFrame:
    """What ``transform`` gave, with ``restored``: the text rebuilt from ``output`` and ``form`` alone."""
    common.prepare(done.sparkSession)
    names = [c for c in done.columns if c.lower() != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = CODE_POINTS.automaton()
        for batch in batches:
            form, output = (batch.column(names.index(c)) for c in ("form", "output"))
            texts = [rebuilt(o.as_py(), f.as_py(), automaton) for o, f in zip(output, form)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "restored"])

    rows = done.select(*[F.col(f"`{c}`") for c in names])
    return rows.mapInArrow(run, T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema], T.StructField("restored", T.StringType())]))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = transform(docs).select("doc_id", "form", "prefix_chars", "middle_chars", "output", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    shas = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return restore(done).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *shas)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS r1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS r2,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (SELECT doc_id, t, n, form, least(r1, r2) AS a, greatest(r1, r2) AS b, t[1:least(r1, r2)] AS pre, substring(t, least(r1, r2) + 1, abs(r1 - r2)) AS mid, substring(t, greatest(r1, r2) + 1) AS suf FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
