"""Roots and families of sessions, by rounds that are cut to the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sequences


def ready(df: DataFrame) -> None:
    """Names a checkpoint folder where the session has none; a cluster must name its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))


def roots(nodes: DataFrame) -> DataFrame:
    ready(nodes)
    return sequences.roots(nodes)


def families(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, family): the least id reachable over edges (u, v). Minima spread over edges, then labels jump to theirs."""
    ready(nodes)
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct().checkpoint()
    at = nodes.select("id", F.col("id").alias("family")).checkpoint()
    while True:
        near = both.join(at.select(F.col("id").alias("v"), "family"), "v").groupBy(F.col("u").alias("id")).agg(F.min("family").alias("low"))
        step = at.join(near, "id", "left").select("id", "family", F.least("family", F.coalesce("low", "family")).alias("now"))
        jump = step.join(step.select(F.col("id").alias("now"), F.col("now").alias("next")), "now").select("id", "family", F.least("now", "next").alias("now")).checkpoint()
        moved = not jump.filter("now <> family").isEmpty()
        at = jump.select("id", F.col("now").alias("family"))
        if not moved:
            return at
