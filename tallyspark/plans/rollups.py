"""Day rollups that are built again only where facts changed.

The ledger keeps one table of finished days with the fingerprint they were built under. A refresh takes the dirty UTC
days, drops the local days they touch (each its neighbours too), and the days of another fingerprint, builds what the
spine then lacks in one plan, and commits both together. The cutoff's own day is never kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ledger as capture
from .store import Ledger

TABLE = "rollup_days"


def refresh(store: Ledger, days: DataFrame, dirty: DataFrame, fingerprint: str, cutoff_date: str, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """All of ``days`` (date string) as ``build`` gives them, and how many were built. ``build`` takes the dates it must give."""
    base = store.manifest()
    kept = store.read(TABLE, base)
    if kept is not None:
        fresh = capture.invalidated(kept.select("date"), dirty).filter("not stale").select("date")
        kept = kept.filter(F.col("fingerprint") == fingerprint).join(fresh, "date", "left_semi")
        todo = days.join(kept.select("date"), "date", "left_anti")
    else:
        todo = days
    n = todo.count()
    built = build(todo).withColumn("fingerprint", F.lit(fingerprint))
    whole = built if kept is None else built.unionByName(kept.select(*built.columns))
    store.commit({TABLE: whole.filter(F.col("date") < cutoff_date)}, base=base)
    last = build(todo.filter(F.col("date") >= cutoff_date))
    finished = store.read(TABLE).drop("fingerprint").join(days, "date", "left_semi")
    return finished.unionByName(last), n
