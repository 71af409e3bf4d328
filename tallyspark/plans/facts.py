"""Fact tables by day, of which a merge rewrites only the days it touches, and their scope as it is at present.

A table is a folder of ``day=...`` partitions (``undated`` for facts without a time). A merge replaces the rows of the
batch's keys wherever they are: days that hold old or new rows of these keys are written anew by dynamic partition
overwrite, all others stay as files. Merging a batch twice changes nothing, so a run that failed is done again. A day whose
last row moved away keeps one empty marker row, as overwriting never drops a partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lineage, state


def _exists(spark: SparkSession, folder: str, table: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _all(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    if not _exists(spark, folder, table):
        return None
    return spark.read.option("mergeSchema", "true").parquet(f"{folder}/{table}").withColumn("day", F.col("day").cast("string"))


def read(spark: SparkSession, folder: str, table: str, days: Column | None = None) -> DataFrame | None:
    """A table's facts; a condition on ``day`` prunes partitions."""
    df = _all(spark, folder, table)
    return None if df is None else (df if days is None else df.filter(days)).filter("not _gone").drop("_gone", "day")


def day_of(ms: str) -> Column:
    """The UTC day of a fact, by which tables are partitioned."""
    return F.coalesce(F.to_date(F.timestamp_millis(F.col(ms))).cast("string"), F.lit("undated"))


def _write(df: DataFrame, days: DataFrame, folder: str, table: str) -> None:
    """``df`` in place of all that ``days`` held."""
    empty = days.select("day").distinct().join(df.select("day").distinct(), "day", "left_anti")
    marks = empty.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "day" else F.col("day") for f in df.schema.fields]).withColumn("_gone", F.lit(True))
    out = df.withColumn("_gone", F.lit(False)).unionByName(marks)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{folder}/{table}")


def merge(spark: SparkSession, folder: str, table: str, batch: DataFrame, key: str, ms: str) -> DataFrame:
    """Puts the batch's facts in by key, and gives the days that were written."""
    lineage.ready(batch)
    batch = batch.withColumn("day", day_of(ms)).checkpoint()
    old = _all(spark, folder, table)
    if old is None:
        _write(batch, batch.select("day"), folder, table)
        return batch.select("day").distinct()
    known = old.filter("not _gone").drop("_gone")
    days = batch.select("day").union(known.join(batch.select(key), key, "left_semi").select("day")).distinct().checkpoint()
    stay = known.join(F.broadcast(days), "day", "left_semi").join(batch.select(key), key, "left_anti")
    _write(stay.unionByName(batch, allowMissingColumns=True).checkpoint(), days, folder, table)
    return days


def _above(path: Column) -> Column:
    """A path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))


TUPLE = ["agent", "session", "workspace", "repository"]


def resolved(tuples: DataFrame, places: DataFrame, roots: DataFrame, repositories: DataFrame, historical: DataFrame, cached: DataFrame) -> DataFrame:
    """Each distinct (agent, session, workspace, repository) with workspace_key, repository_key, decision and scope_reason.

    ``places``: path, live (its real path), common (its repository's folder), for paths that exist; ``roots``: path;
    ``repositories``: path, common; ``historical``: nth, path, exact, repository; ``cached``: agent, session, workspace,
    repository. A path lies within a folder if the folder is among those above it, so containment is a join on equal paths.

    The first that holds decides: two live repositories conflict; a live one is included if it is configured, else out of
    scope; a path within a root; a mapping of old paths, then an attribution of an earlier run, each to a repository
    that is included; else out of scope, or unattributed where there is no path.
    """
    lineage.ready(tuples)
    t = tuples.select(*TUPLE).distinct().withColumn("tid", F.xxhash64(*TUPLE))
    absolute = lambda c: F.when(F.startswith(c, F.lit("/")), F.when(c == "/", c).otherwise(F.rtrim(c, F.lit("/"))))
    t = t.withColumns({"lex": absolute(F.col("workspace")), "lex_repository": absolute(F.col("repository"))})
    where = places.select("path", "live", "common").dropDuplicates(["path"])
    at = lambda name, c: where.select(F.col("path").alias(c), F.col("live").alias(f"{name}_live"), F.col("common").alias(f"{name}_common"))
    t = t.join(at("w", "lex"), "lex", "left").join(at("r", "lex_repository"), "lex_repository", "left").checkpoint()

    paths = t.select("tid", F.explode(F.array_distinct(F.array_compact(F.array("w_live", "r_live", "lex")))).alias("path"))
    rooted = paths.select("tid", F.explode(_above(F.col("path"))).alias("path")).join(roots.select("path").distinct(), "path", "left_semi").select("tid").distinct().withColumn("rooted", F.lit(True))
    known = repositories.groupBy("common").agg(F.min("path").alias("own"))
    # A repository is included if it is configured, holds or lies in a configured one, or lies in a root.
    wanted = historical.select("repository").union(cached.select("repository")).distinct()
    up = wanted.select("repository", F.explode(_above(F.col("repository"))).alias("path"))
    inside = up.join(repositories.select("path").union(roots.select("path")).distinct(), "path", "left_semi").select("repository")
    holds = repositories.select(F.explode(_above(F.col("path"))).alias("repository")).join(wanted, "repository", "left_semi")
    included = inside.union(holds).distinct()

    old = t.filter("lex is not null").select("tid", "lex", F.explode(_above(F.col("lex"))).alias("path")).join(historical, "path").filter(~F.col("exact") | (F.col("path") == F.col("lex")))
    old = old.groupBy("tid").agg(F.min(F.struct("nth", "repository", "exact")).alias("x")).select("tid", F.col("x.repository").alias("old"), F.col("x.exact").alias("exact"))
    old = old.join(included.select(F.col("repository").alias("old")), "old", "left_semi")
    was = t.join(cached.select("agent", "session", F.col("workspace").alias("lex"), F.col("repository").alias("was")), ["agent", "session", "lex"]).join(included.select(F.col("repository").alias("was")), "was", "left_semi").groupBy("tid").agg(F.min("was").alias("was"))

    t = t.withColumn("identity", F.coalesce("w_common", "r_common")).join(known.select(F.col("common").alias("identity"), "own"), "identity", "left").join(rooted, "tid", "left").join(old, "tid", "left").join(was, "tid", "left")
    live, lex = F.coalesce("w_live", "r_live"), F.col("lex")
    unknown = F.lit("unattributed")
    ladder = [
        (F.coalesce(F.col("w_common") != F.col("r_common"), F.lit(False)), F.coalesce("w_live", lex, unknown), None, "unattributed", F.lit("attribution-conflict")), (F.col("own").isNotNull(), F.coalesce(live, lex, "own"), "own", "included", F.lit("repository-identity")),
        (F.col("identity").isNotNull(), F.coalesce(live, lex, unknown), None, "out-of-scope", F.lit("unrelated-live-repository")), (F.col("rooted"), F.coalesce(live, lex), None, "included", F.lit("configured-root")),
        (F.col("old").isNotNull(), lex, "old", "included", F.when(F.col("exact"), "historical-exact").otherwise("historical-prefix")), (F.col("was").isNotNull(), lex, "was", "included", F.lit("cached-attribution")),
        (lex.isNotNull(), lex, None, "out-of-scope", F.lit("outside-configured-scope")),
    ]
    none = F.struct(unknown.alias("workspace_key"), F.lit(None).cast("string").alias("repository_key"), F.lit("unattributed").alias("decision"), F.lit("attribution-unavailable").alias("scope_reason"))
    step = lambda w, r, d, why: F.struct(w.alias("workspace_key"), (F.lit(None) if r is None else F.col(r)).cast("string").alias("repository_key"), F.lit(d).alias("decision"), why.alias("scope_reason"))
    chosen = reduce(lambda rest, x: F.when(F.coalesce(x[0], F.lit(False)), step(*x[1:])).otherwise(rest), reversed(ladder), none)
    return t.select(*TUPLE, chosen.alias("x")).select(*TUPLE, "x.*")


SCOPE = ["workspace_key", "repository_key", "decision", "scope_reason"]


def rescoped(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """Stored facts with the scope that their (agent, session, workspace, repository) has now, and ``changed``."""
    s = scope.select(*[F.col(c).alias(f"_{c}") for c in (*TUPLE, *SCOPE)])
    j = rows.join(s, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TUPLE]), "left")
    told = F.col("_decision").isNotNull()
    changed = told & reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SCOPE])
    return j.select(*[F.when(told, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in SCOPE else F.col(c) for c in rows.columns], changed.alias("changed"))


def rescope(spark: SparkSession, folder: str, table: str, scope: DataFrame) -> DataFrame | None:
    """Brings a stored table's scope up to date, writing only days in which any fact's scope changed; gives those days. Nothing is deleted."""
    known = _all(spark, folder, table)
    if known is None:
        return None
    lineage.ready(known)
    done = rescoped(known.filter("not _gone").drop("_gone"), scope)
    days = done.filter("changed").select("day").distinct().checkpoint()
    if not days.isEmpty():
        _write(done.drop("changed").join(F.broadcast(days), "day", "left_semi").checkpoint(), days, folder, table)
    return days


def source_states(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Source states after a run: those not in it stay; an unavailable one keeps its last good scan and adds its reasons to what was known."""
    if old is None:
        return new
    was = old.select("source", F.col("reasons").alias("_reasons"), F.col("good_ms").alias("_good"))
    lost = F.col("quality") == "unavailable"
    j = new.join(was, "source", "left")
    both = F.array_sort(F.array_distinct(F.concat("reasons", F.coalesce("_reasons", F.array().cast("array<string>")))))
    now = j.withColumns({"reasons": F.when(lost, both).otherwise(F.col("reasons")), "good_ms": F.when(lost, F.col("_good")).otherwise(F.col("good_ms"))}).select(*new.columns)
    return old.join(new.select("source"), "source", "left_anti").select(*new.columns).unionByName(now)


def collect(spark: SparkSession, folder: str, run: int, states: DataFrame, batches: dict[str, tuple[DataFrame, str, str]], scope: DataFrame) -> None:
    """One run: facts of sources that are there go in by key, states are refreshed, and all stored facts take the present scope.

    ``states``: source, quality, reasons, good_ms (last good scan); ``batches``: table: (facts with ``source``, key, time).
    A source that isn't available changes its state only: its facts stay. That holds for a rebuild too, which differs in
    reading sources from the start (no cursors), not in what is kept.
    """
    def step(was):
        return {"sources": source_states(was["sources"], states)}

    there = states.filter("quality <> 'unavailable'").select("source")
    for table, (rows, key, ms) in batches.items():
        merge(spark, folder, table, rows.join(F.broadcast(there), "source", "left_semi"), key, ms)
    state.advance(spark, folder, run, ("sources",), step)
    for table in batches:
        rescope(spark, folder, table, scope)
