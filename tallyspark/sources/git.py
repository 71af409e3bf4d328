"""Commit history of local repositories as (repository, oid, committer_ms, shallow)."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "repository string, oid string, committer_ms long, shallow boolean, problem string, malformed long"


def parsed(repository: str, text: str, shallow: bool) -> tuple[list[tuple], int]:
    """Rows of ``oid<TAB>seconds`` lines, and how many lines aren't that."""
    rows, bad = [], 0
    for line in text.splitlines():
        oid, _, seconds = line.partition("\t")
        if len(oid) in (40, 64) and set(oid) <= set("0123456789abcdef") and seconds.isdigit():
            rows.append((repository, oid, int(seconds) * 1000, shallow))
        else:
            bad += 1
    return rows, bad


def scanned(spark: SparkSession, repositories: list[str]) -> DataFrame:
    """Commits of each repository's default branch, and a row without a commit for each repository: what went wrong, and malformed lines.

    A repository is read by one task, never by the driver. Problems: ``missing-ref`` without a remote default branch,
    ``unreadable`` if git can't tell; such a repository has no commits here, and its earlier ones must stay.
    """

    def read(batches):
        import pandas as pd

        for batch in batches:
            for r in batch["repository"]:
                git = lambda *a: subprocess.run(["git", "-C", r, *a], capture_output=True, text=True, timeout=600)  # noqa: E731, B023
                state = git("rev-parse", "--is-shallow-repository")
                shallow = state.stdout.strip() == "true"
                log = git("log", "--format=%H%x09%ct", "origin/HEAD") if git("rev-parse", "--verify", "--quiet", "origin/HEAD").returncode == 0 else None
                problem = "unreadable" if state.returncode else "missing-ref" if log is None else "unreadable" if log.returncode else None
                rows, bad = ([], 0) if problem else parsed(r, log.stdout, shallow)
                told = [(*x, None, None) for x in rows] + [(r, None, None, shallow, problem, bad)]
                yield pd.DataFrame(told, columns=["repository", "oid", "committer_ms", "shallow", "problem", "malformed"])

    names = spark.createDataFrame([(r,) for r in repositories], "repository string").repartition(max(1, len(repositories)))
    return names.mapInPandas(read, SCHEMA).dropDuplicates(["repository", "oid"])


def commits(found: DataFrame) -> DataFrame:
    """(repository, oid, committer_ms, shallow) of a scan."""
    return found.filter("oid is not null").drop("problem", "malformed")


def problems(found: DataFrame) -> DataFrame:
    """(repository, shallow, problem, malformed): one row a repository; no problem is null."""
    return found.filter("oid is null").select("repository", "shallow", F.col("problem"), "malformed")
