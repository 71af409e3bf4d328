"""What sources and repositories there are: probes of headers, an inventory in a fixed order, repositories grouped by common folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.quality import combined
from . import walk

#: The order of sources in reports; the last two are only listed, never read.
ORDER = ("codex", "claude", "omp", "opencode", "hermes", "kimi", "grok")
LISTED = {"kimi": (".kimi-code/bin", "^kimi$"), "grok": ("Library/Application Support/Grok Bot/sand-client-persistence", r"\.blob$")}
LEAST_VERSION = 3


def _first_lines(head: Column, n: int) -> Column:
    """The first whole lines of a file's head."""
    return F.slice(F.split(F.decode(head, "UTF-8"), "\n"), 1, n)


def probed(files: DataFrame) -> DataFrame:
    """Files with ``layout``: envelope, flat, headed, unsupported (a header of another version) or unknown, by their first lines."""
    text = lambda line, path: F.get_json_object(line, f"$.{path}")
    f = files.withColumn("_lines", F.filter(_first_lines(F.col("head"), 8), lambda x: F.length(F.trim(x)) > 0))
    one, two = F.get("_lines", F.lit(0)), F.get("_lines", F.lit(1))
    head = F.when(text(one, "type") == "title", two).otherwise(one)
    flat = F.exists("_lines", lambda x: text(x, "sessionId").isNotNull() & text(x, "type").isNotNull())
    layout = (
        F.when(F.col("kind") != "file", F.col("kind")).when(text(one, "type") == "session_meta", "envelope")
        .when(text(head, "type") == "session", F.when((text(head, "version") == str(LEAST_VERSION)) & (F.length(text(head, "id")) > 0), "headed").otherwise("unsupported")).when(flat, "flat").otherwise("unknown")
    )
    return f.withColumn("layout", layout).drop("_lines")


def report(found: DataFrame) -> DataFrame:
    """One row for each source, in the fixed order: (agent, state, tokens, paths, supported, unsupported, unreadable, reasons).

    ``found``: agent, path (null: nothing there), supported (null: can't be read). A source that is only listed never
    has tokens. Paths are counted, not listed: reports name no files.
    """
    sources = found.sparkSession.createDataFrame([(a, k) for k, a in enumerate(ORDER)], "agent string, place int")
    counted = found.filter("path is not null").dropDuplicates(["agent", "path"]).groupBy("agent").agg(F.count("*").alias("paths"), F.count_if(F.col("supported")).alias("supported"), F.count_if(~F.col("supported")).alias("unsupported"), F.count_if(F.col("supported").isNull()).alias("unreadable"))
    r = F.broadcast(sources).join(counted, "agent", "left").fillna(0, ["paths", "supported", "unsupported", "unreadable"])
    listed = F.col("agent").isin(*LISTED)
    good, bad, lost = F.col("supported"), F.col("unsupported"), F.col("unreadable")
    state = F.when(F.col("paths") == 0, "not-found").when((good == 0) & (bad > 0) & (lost == 0), "unsupported-schema").when(listed, "installed-no-history").when(good == F.col("paths"), "available").otherwise("partial")
    reasons = F.array(F.when(F.col("paths") == 0, "missing-source"), F.when(bad > 0, "unsupported-schema"), F.when(lost > 0, "parse-gap"))
    tokens = F.when(listed | (good == 0), "unavailable").when(good == F.col("paths"), "recorded").otherwise("partial")
    return r.select("place", "agent", state.alias("state"), tokens.alias("tokens"), "paths", "supported", "unsupported", "unreadable", F.array_sort(F.array_compact(reasons)).alias("reasons")).orderBy("place").drop("place")


def inventory(spark: SparkSession, home: str, roots: dict[str, list[str]]) -> DataFrame:
    """The report over JSON-lines roots by agent, and the sources that are only listed, below ``home``."""
    wanted = {"codex": "envelope", "claude": "flat", "omp": "headed"}
    none = spark.createDataFrame([], "agent string, path string, supported boolean")
    for agent, layout in wanted.items():
        if roots.get(agent):
            p = probed(walk.files(spark, roots[agent], r"\.jsonl$", walk.HEAD)).filter("kind in ('file', 'unreadable')")
            none = none.unionByName(p.select(F.lit(agent).alias("agent"), "path", F.when(F.col("kind") == "file", F.col("layout") == layout).alias("supported")))
    for agent, (folder, names) in LISTED.items():
        p = walk.files(spark, [f"{home}/{folder}"], names).filter("kind = 'file'")
        none = none.unionByName(p.select(F.lit(agent).alias("agent"), "path", F.when(F.lit(agent == "grok"), F.lit(False)).alias("supported")))
    return report(none)


def lineage(threads: DataFrame, spawned: DataFrame) -> DataFrame:
    """(session, parent, path) from a side database: threads (id, rollout_path), spawn edges (parent_thread_id, child_thread_id).

    A child that several parents claim, or that claims itself, has none.
    """
    up = spawned.filter("parent_thread_id <> child_thread_id").groupBy(F.col("child_thread_id").alias("session")).agg(F.when(F.count_distinct("parent_thread_id") == 1, F.min("parent_thread_id")).alias("parent"))
    return threads.select(F.col("id").alias("session"), F.col("rollout_path").alias("path")).dropDuplicates(["session"]).join(up, "session", "left").select("session", "parent", "path")


def repositories(found: DataFrame, configured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repositories, problems): one row for each common folder, and what was left out and why.

    ``found``: path, kind, common, as the walk gives them; ``configured``: path, remote, branch, common (null: no
    repository there). Of the worktrees of a common folder a configured one stands for it, else the one whose own folder it
    is, else the least path. Configurations of one path or one common folder that differ conflict, and it is left out.
    """
    c = configured.withColumn("setting", F.struct("remote", "branch"))
    clash = lambda keys: c.groupBy(*keys).agg((F.count_distinct(F.xxhash64("setting")) > 1).alias("clash"))
    places = found.filter("kind = 'repository'").select("path", "common").unionByName(c.select("path", "common")).dropDuplicates(["path"])
    by_path = c.groupBy("path").agg(F.min("setting").alias("setting")).join(clash(["path"]), "path")
    p = places.filter("common is not null").join(by_path, "path", "left")
    order = F.struct(F.col("setting").isNull(), F.concat("path", F.lit("/.git")) != F.col("common"), F.col("path"))
    one = p.groupBy("common").agg(
        F.min_by("path", order).alias("path"), F.min("setting").alias("setting"), F.count("*").alias("worktrees"), (F.coalesce(F.bool_or("clash"), F.lit(False)) | (F.count_distinct(F.when(F.col("setting").isNotNull(), F.xxhash64("setting"))) > 1)).alias("clash"),
    )
    good = one.filter("not clash").select(fields.joined_id(F.lit("repository"), F.col("common")).alias("repository"), "path", "common", F.coalesce("setting.remote", F.lit("origin")).alias("remote"), F.col("setting.branch").alias("branch"), "worktrees")
    code = lambda df, name: df.select(F.lit(name).alias("code"), "path")
    problems = code(one.filter("clash"), "duplicate-config-conflict").unionByName(code(places.filter("common is null"), "common-dir-unavailable"))
    return good, problems.unionByName(code(found.filter("kind = 'symlink-escape'"), "symlink-escape")).unionByName(code(found.filter("kind = 'unreadable'"), "root-unavailable"))


def quality(report_: DataFrame) -> DataFrame:
    """The quality of all sources that are read, as one row."""
    return report_.filter(~F.col("agent").isin(*LISTED)).agg(combined("tokens").alias("tokens"))
