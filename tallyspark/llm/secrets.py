"""Secret scans over an incremental blob ledger.

Every version of every text is addressed by its content (SHA-256). The ledger holds a row for each scanned pair of
blob and rule version with its findings; ``update`` scans only blobs that the ledger hasn't under the present
``RULES_VERSION``, once however many paths carry them, and ``findings_by_path`` joins the findings back to all paths.

Texts are scanned where they lie. Only addresses are shuffled: each new blob chooses its first path, and texts that can't
be copies by a bitmap of the other paths (``common.chosen``) are scanned in place; only where that bitmap errs for more than
``common.FEW`` paths are those few texts shuffled. A row repeated whole is scanned where it stands and folded afterwards.
The join back carries ids and addresses and spreads blobs with very many paths.

A null text is the empty blob. Rows are handled one by one, repeated ones too; null ids keep their row; other
columns are ignored. Spans are counted in code points of the whole text, the whole match, end exclusive. Very long texts
are scanned whole, one row at a time; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES_VERSION = 1
KINDS = ("assign", "access", "hex", "pem")
#: {n,} stands for the least length: a shorter run that fails can't hold a longer one.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
_HINTS = ("passw", "secret", "token", "api")


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every finding, by start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in _ACCESS.finditer(text)]
    out += [(2, *m.span()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        out += [(3, *m.span()) for m in _PEM.finditer(text)]
    return [(KINDS[k], a, b) for k, a, b in sorted(out, key=lambda x: (x[1], x[0]))]


def _told(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches):
    for batch in batches:
        found = [scan(t.as_py() or "") for t in batch.column(1)]
        base = [[s for s in f if s[0] != "pem"] for f in found]
        counts = [pa.array([sum(s[0] == k for s in f) for f in found], pa.int64()) for k in KINDS[:3]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(_told(b).encode()).hexdigest() for b in base]), pa.array([_told(f) for f in found])], ["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def paths(docs: DataFrame) -> DataFrame:
    """(doc_id, text, blob) of every version."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def update(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger's new rows: blobs of ``docs`` that ``ledger`` hasn't under these rules, each scanned once."""
    common.prepare(docs.sparkSession)
    rows = paths(docs).withColumn("at", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "blob"))
    ids = common.cut(rows.select("at", "blob").distinct())
    first = ids.groupBy("blob").agg(F.min("at").alias("at"))
    if ledger is not None:
        first = first.join(ledger.filter(F.col("rules") == RULES_VERSION).select("blob"), "blob", "left_anti")
    first = common.cut(first.select("at"))
    texts = common.chosen(rows.select("at", "blob", "text"), first, common.cut(ids.join(first, "at", "left_anti").select("at")), "at")
    found = texts.select("blob", "text").mapInArrow(_scan, "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.dropDuplicates(["blob"]).withColumn("rules", F.lit(RULES_VERSION))


def findings_by_path(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    rows = paths(docs).select("doc_id", "blob")
    found = ledger.filter(F.col("rules") == RULES_VERSION).drop("rules").join(rows.groupBy("blob").agg(F.count("*").alias("size")), "blob")
    return common.spread(rows, common.cut(found), ["blob"], F.length("spans"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return findings_by_path(docs, update(docs)).drop("blob")
