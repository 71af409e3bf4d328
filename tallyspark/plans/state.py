"""Keyed state between runs, as one Parquet folder a run.

Run n reads the state that the last run before it left and writes ``run=n``; a run that was cut off is done again from
the same state and takes the place of what it left, so every run is idempotent. Spark alone reads and writes the
folder, so it may lie in any store that Spark reaches. A run that wrote no ``_SUCCESS`` doesn't count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def runs(spark: SparkSession, folder: str, table: str) -> list[int]:
    """Whole runs of a table, ascending."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[4:]) for n in names if n.startswith("run=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}/{n}/_SUCCESS")))


def before(spark: SparkSession, folder: str, table: str, run: int) -> DataFrame | None:
    """What the last run before ``run`` left."""
    done = [r for r in runs(spark, folder, table) if r < run]
    return spark.read.parquet(f"{folder}/{table}/run={done[-1]}") if done else None


def put(df: DataFrame, folder: str, table: str, run: int) -> DataFrame:
    path = f"{folder}/{table}/run={run}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def advance(spark: SparkSession, folder: str, run: int, tables: tuple[str, ...], step: Callable[[dict[str, DataFrame | None]], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """One run: ``step`` gets the state tables as they were and gives all of its results by name, state tables among them.

    State tables are written last, so a run that fails leaves the state as it was.
    """
    made = step({t: before(spark, folder, t, run) for t in tables})
    facts = [t for t in made if t not in tables]
    return {t: put(made[t], folder, t, run) for t in [*facts, *[t for t in made if t in tables]]}
