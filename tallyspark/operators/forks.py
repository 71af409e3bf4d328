"""Fork families of session files, the canonical member of each, and what that decides: replayed inputs and usage kept once.

Four kinds of edges make a family: files of one session id; a file and an earlier one that it names; files that name the
same earlier file though it is missing (the missing file is a node like any other); and children that lie at the same
place under parents of one family. The last kind depends on families, so it is added until no more families meet: one
round for each level of nesting. The canonical member is the earliest by (header time, path), files without a time last.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("uncached", "cache_read", "cache_write", "output", "reasoning", "total")
_NEVER = 2**63 - 1


def owners(files: DataFrame, extension: str = ".jsonl") -> DataFrame:
    """(path, owner, child): files below the folder that another file's name (without its extension) gives, the nearest one, and the place below it.

    A path is looked up by each of its folders, so the join is on equal paths and a file costs as many rows as it lies deep.
    """
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder"))
    hit = above.withColumn("owner", F.concat("folder", F.lit(extension))).join(files.select(F.col("path").alias("owner")).distinct(), "owner").filter("owner <> path")
    near = hit.groupBy("path").agg(F.max_by(F.struct("owner", "folder"), F.length("folder")).alias("x"))
    return near.select("path", "x.owner", F.substring("path", F.length("x.folder") + 2, F.lit(1 << 30)).alias("child"))


def families(files: DataFrame, components: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(path, family) of files (path, session, previous: array of resolved paths); ``components`` gives (id, family) of nodes (id) and edges (u, v)."""
    node = lambda kind, *x: F.concat(F.lit(kind), *x)
    file = node("file:", "path")
    edges = files.select(file.alias("u"), node("session:", "session").alias("v")).union(files.select(file.alias("u"), F.explode("previous").alias("p")).select("u", node("file:", "p")))
    below = owners(files)
    count = -1
    while True:
        nodes = edges.select(F.col("u").alias("id")).union(edges.select("v")).union(files.select(file)).distinct()
        found = components(nodes, edges)
        now = found.select("family").distinct().count()
        if now == count:
            return found.filter(F.startswith("id", F.lit("file:"))).select(F.substring("id", F.lit(6), F.length("id")).alias("path"), "family").join(files.select("path").distinct(), "path")
        count = now
        held = below.join(found.select(F.substring("id", F.lit(6), F.length("id")).alias("owner"), "family"), "owner")
        edges = edges.union(held.select(file.alias("u"), node("child:", "family", F.lit(":"), "child").alias("v")))


def canonical(files: DataFrame, grouped: DataFrame) -> DataFrame:
    """(family, path, session) of the canonical member: the earliest by header time, then path."""
    order = F.struct(F.coalesce("header_ms", F.lit(_NEVER)), F.col("path"))
    return files.join(grouped, "path").groupBy("family").agg(F.min_by(F.struct("path", "session"), order).alias("x")).select("family", "x.path", "x.session")


def marked(inputs: DataFrame, grouped: DataFrame, first: DataFrame) -> DataFrame:
    """Inputs (path, session, native_input, at_ms, kind, quality, reasons) of which those that a family holds again are replays.

    Of the inputs of one native id in a family the canonical file's first is the owner, else the earliest by (time,
    session); it counts as submitted unless its kind is unknown, the others as replays.
    """
    main = first.select("path", F.lit(True).alias("main"))
    rows = inputs.join(grouped, "path").join(main, "path", "left").withColumn("_row", F.xxhash64(F.struct(*[F.col(c) for c in inputs.columns])))
    order = F.struct(F.coalesce(~F.col("main"), F.lit(True)).alias("aside"), F.coalesce("at_ms", F.lit(_NEVER)).alias("at"), F.col("session").alias("session"), F.col("path").alias("path"), F.col("_row").alias("row"))
    owner = rows.groupBy("family", "native_input").agg(F.min(order).alias("o"), F.count("*").alias("n"))
    j = rows.join(owner, ["family", "native_input"])
    own = (F.col("o.path") == F.col("path")) & (F.col("o.row") == F.col("_row"))
    many, other = F.col("n") > 1, (F.col("n") > 1) & ~own
    none = F.array().cast("array<string>")
    done = {
        "kind": F.when(other, "replay").when(many & (F.col("kind") != "unknown"), "submission").otherwise(F.col("kind")), "quality": F.when(other, "recorded").otherwise(F.col("quality")),
        "reasons": F.when(other, none).otherwise(F.col("reasons")),
    }
    return j.withColumns(done).select("family", *inputs.columns)


def identity(family: Column) -> Column:
    """What tells a usage record apart: its response, else its entry in the family, else its accounting in the family."""
    told = F.concat_ws("|", "kind", F.coalesce(F.col("at_ms").cast("string"), F.lit("unknown")), "provider", "model", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in COUNTS])
    return (
        F.when(F.col("response").isNotNull(), F.concat_ws(":", F.lit("response"), "provider", "response")).when(F.col("entry").isNotNull(), F.concat_ws(":", F.lit("entry"), family, "entry"))
        .otherwise(F.concat_ws(":", F.lit("print"), family, F.sha2(told, 256)))
    )


def selected(usage: DataFrame, grouped: DataFrame, first: DataFrame) -> DataFrame:
    """One usage record for each identity, ``excluded``: how many it stands for beyond itself where they conflict.

    ``usage``: path, line, kind (message or model_usage), response, entry, at_ms, provider, model, COUNTS, quality, reasons.
    The canonical file's comes first, messages before model usage, more known counts, earlier lines. They conflict if
    any differs from the chosen one in a count, or, without a response, in time, provider, model or kind.
    """
    main = first.select("path", F.lit(True).alias("main"), F.col("session").alias("owner"))
    rows = usage.join(grouped, "path").join(main.select("path", "main"), "path", "left").join(first.select("family", F.col("session").alias("canonical")), "family")
    known = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in COUNTS])
    counts = F.struct(*COUNTS)
    told = F.when(F.col("response").isNull(), F.struct("kind", "at_ms", "provider", "model", *COUNTS))
    rows = rows.withColumns({"origin": F.sha2(identity(F.col("canonical")), 256), "counts": F.xxhash64(counts), "told": F.when(told.isNotNull(), F.xxhash64(told))})
    order = F.struct(F.coalesce(~F.col("main"), F.lit(True)), F.col("kind") != "message", -known, F.col("line"), F.col("path"))
    one = rows.groupBy("origin").agg(F.min_by(F.struct(*usage.columns, "family"), order).alias("r"), F.count("*").alias("n"), (F.min("counts") != F.max("counts")).alias("a"), F.coalesce(F.min("told") != F.max("told"), F.lit(False)).alias("b"))
    clash = F.col("a") | (F.col("b") & F.col("r.response").isNull())
    out = one.select("origin", "r.*", clash.alias("clash"), F.when(clash, F.col("n") - 1).otherwise(0).alias("excluded"))
    codes = F.array_sort(F.array_distinct(F.concat("reasons", F.array(F.lit("duplicate-ambiguity")))))
    return out.withColumns({"quality": F.when(F.col("clash"), "partial").otherwise(F.col("quality")), "reasons": F.when(F.col("clash"), codes).otherwise(F.col("reasons"))}).drop("clash")
