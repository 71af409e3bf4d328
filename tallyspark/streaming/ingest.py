"""Incremental ingest: JSON lines as a stream, each micro-batch normalised, deduplicated and committed to the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import facts
from ..plans.store import Ledger, upserted
from ..sources import jsonl


def ingest(spark: SparkSession, path: str, ledger: Ledger, table: str, keys: list[str], ordinal: str, normalise: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Reads what is new under ``path`` and ends. A batch that was committed before a failure isn't put in twice: keys decide."""
    jsonl.register(spark)
    lines = spark.readStream.format("ledger_jsonl").option("path", path).load()

    def put(batch: DataFrame, number: int) -> None:
        base = ledger.manifest()
        if base["cursors"].get(checkpoint, -1) >= number:
            return
        facts = normalise(batch.filter("gap is null"))
        ledger.commit({table: upserted(ledger.read(table, base), facts, keys, ordinal)}, {checkpoint: number}, base)

    lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def into_facts(spark: SparkSession, path: str, folder: str, table: str, key: str, ordinal: str, ms: str, normalise: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Reads what is new under ``path`` and ends; each micro-batch rewrites only the days that it touches.

    Of a batch's rows of one key the last by ``ordinal`` counts. The stream's checkpoint tells what was read; a batch that
    was merged before a failure is merged again without effect, as keys decide. Any store that Spark reaches will do.
    """
    jsonl.register(spark)
    lines = spark.readStream.format("ledger_jsonl").option("path", path).load()

    def put(batch: DataFrame, number: int) -> None:
        rows = normalise(batch.filter("gap is null"))
        last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), ordinal).alias("r")).select(key, "r.*")
        facts.merge(spark, folder, table, last, key, ms)

    lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
