"""A versioned ledger of Parquet tables: each commit writes new table versions, then renames one manifest into place.

The manifest is the only commit point, for facts and source cursors alike; a failed commit leaves files that no
manifest names. Versions are immutable, so a reader that pinned one is never disturbed. A version's manifest is made
only where there is none yet, so of two writers that began from one version the later raises. The folder is one that the
driver sees as files.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    def manifest(self) -> dict:
        versions = [int(n[len("manifest-") : -len(".json")]) for n in os.listdir(self.folder) if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return {"version": 0, "tables": {}, "cursors": {}}
        with open(f"{self.folder}/manifest-{max(versions)}.json") as f:
            return json.load(f)

    def read(self, table: str, manifest: dict | None = None) -> DataFrame | None:
        path = (manifest or self.manifest())["tables"].get(table)
        return self.spark.read.parquet(f"{self.folder}/{path}") if path else None

    def commit(self, tables: dict[str, DataFrame], cursors: dict | None = None, base: dict | None = None) -> int:
        """All of ``tables`` and ``cursors`` as one new version."""
        base = base or self.manifest()
        paths = dict(base["tables"])
        for name, df in tables.items():
            paths[name] = f"{name}/{uuid.uuid4()}"
            df.write.parquet(f"{self.folder}/{paths[name]}")
        new = {"version": base["version"] + 1, "tables": paths, "cursors": base["cursors"] | (cursors or {})}
        temp = f"{self.folder}/.{uuid.uuid4()}"
        with open(temp, "w") as f:
            json.dump(new, f)
        try:
            os.link(temp, f"{self.folder}/manifest-{new['version']}.json")  # fails if it is there
        except FileExistsError:
            raise RuntimeError("another commit came first") from None
        finally:
            os.remove(temp)
        return new["version"]


def upserted(old: DataFrame | None, batch: DataFrame, keys: list[str], ordinal: str | None = None) -> DataFrame:
    """``old`` with the batch's rows put in by key; of rows of one key in the batch the last by ``ordinal`` wins."""
    if ordinal:
        batch = batch.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ordinal)))).filter("_k = 1").drop("_k")
    return batch if old is None else old.join(batch.select(*keys), keys, "left_anti").select(*old.columns).unionByName(batch)


def replaced(old: DataFrame | None, batch: DataFrame, key: str) -> DataFrame:
    """Full membership of every ``key`` in the batch: its old rows go."""
    return batch if old is None else old.join(batch.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(batch)
