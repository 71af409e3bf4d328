r"""Line dedup by DataFrame functions alone: lines that many documents hold stay in one of them.

A text is split at ``\n``; a line's key is the line without white space (``[\x20\x09-\x0D]``) at its ends, A-Z
lower-cased. Keys of at least ``LONG`` code points found in at least ``DOCS`` documents lose all their lines, but for
those in the largest doc_id that holds the key. What stays is joined by ``\n`` in its old order.

Only hashes move: lines are exploded to 128-bit keys, (key, doc_id) pairs are made distinct and counted, with partial
sums before each shuffle, so a key of a third of all lines costs one row a task. The keys over the threshold go back
to the lines by broadcast up to ``KEYS`` of them, beyond that by ``common.spread``, which splits hot ones. The places
to drop are gathered for each text, and texts meet them on (doc_id, hash of the text): by broadcast where at most
``ROWS`` texts lose lines, else in a shuffle of the texts, in which AQE splits repeated rows.

A null or empty text is one empty line. Equal rows, and different rows of one doc_id, count as one document; each
row is reassembled by itself. A null doc_id counts as no document, so its rows hold up no key, own none, and lose
whatever others made frequent. A text that loses all lines is empty. Very long texts and lines are read whole. Empty
tables give no rows; other columns are kept by ``drop_lines``, but for ``n_lines`` and ``n_dropped``, which it sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WHITE = " \t\n\x0b\f\r"
LONG, DOCS = 40, 5
#: Keys, and texts that lose lines, are broadcast up to so many.
KEYS, ROWS = 1_000_000, 16_384
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = ("_id", "_t1", "_t2")


def key_of(line: Column) -> Column:
    """``lower`` does for ASCII what ``translate`` does for all texts, faster."""
    key = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _rows(docs: DataFrame) -> DataFrame:
    """Rows as one struct (so that no name clashes), with what tells them apart: ``doc_id`` and 128 bits of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2"), text.alias("_text"))


def keys(rows: DataFrame, long: int = LONG) -> DataFrame:
    """A row for each line of at least ``long`` code points: the text's row, the line's place, and 128 bits of its key."""
    lines = rows.select(*_ROW, F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    lines = lines.filter(F.length(F.btrim("line", F.lit(WHITE))) >= long).withColumn("k", key_of(F.col("line")))
    return lines.select(*_ROW, "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), F.col("k")).alias("h2"))


def frequent(lines: DataFrame, docs: int = DOCS) -> DataFrame:
    """(h1, h2, size, owner) of keys found in at least ``docs`` documents: in how many, and the largest."""
    pairs = lines.filter(F.col("_id").isNotNull()).select("h1", "h2", "_id").distinct()
    return pairs.groupBy("h1", "h2").agg(F.count("*").alias("size"), F.max("_id").alias("owner")).filter(F.col("size") >= docs)


def drops(rows: DataFrame, long: int = LONG, docs: int = DOCS) -> DataFrame:
    """(row, drop): the places that each text loses, for texts that lose any."""
    lines = keys(rows, long)
    heavy = common.cut(frequent(lines, docs))
    if heavy.limit(KEYS + 1).count() <= KEYS:
        hit = lines.join(F.broadcast(heavy), ["h1", "h2"])
    else:
        hit = common.spread(lines, heavy, ["h1", "h2"])
    lost = hit.filter(~F.col("_id").eqNullSafe(F.col("owner")))
    return lost.groupBy(*_ROW).agg(F.collect_set("pos").alias("drop"))


def drop_lines(docs: DataFrame, long: int = LONG, least: int = DOCS) -> DataFrame:
    """``docs`` with its text reassembled, and ``n_lines`` (before) and ``n_dropped``."""
    common.prepare(docs.sparkSession)
    rows = _rows(docs)
    lost = common.cut(drops(rows, long, least).select(*[F.col(c).alias(f"{c}_") for c in _ROW], F.col("drop").alias("_drop")))
    if lost.limit(ROWS + 1).count() <= ROWS:
        lost = F.broadcast(lost)
    both = rows.join(lost, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in _ROW], "left")
    both = both.select("_doc", "_text", F.split("_text", "\n").alias("_lines"), "_drop")  # a projection of its own: split once
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    out = [kept.alias(c) if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return both.select(*out, F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, row, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
heavy AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT k.*, owner IS NOT NULL AND doc_id IS DISTINCT FROM owner AS lost FROM k LEFT JOIN heavy USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM told GROUP BY row
"""
