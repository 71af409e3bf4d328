"""A message/part store read again and again: which rows a run must look at, their parts and prints, and what it remembers.

A session is read when it is new or its update time changed. Of its messages those count (``account``) that are new, at
or after the session's watermark (inclusive, as rows of one millisecond may come in two runs), changed since, or
incomplete when last seen. Parts are fetched only for messages that need a new print; the others keep the stored one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields
from ..sources import normalise
from . import kinds

#: Keys of native JSON that tell who, not what; they are left out of prints.
IDENTITY = ("id", "sessionID", "sessionId", "session_id", "messageID", "messageId", "message_id", "parentID", "parentId", "parent_id")
#: The keys of an ordinary submitted message and of its text parts, sorted.
ORDINARY, TEXT = ("agent", "model", "role", "summary", "time"), ("text", "type")
WATERMARKS = "session string, watermark_ms long, updated_ms long"
SEEN = "session string, message string, print string, updated_ms long, partial boolean"
_COUNT = T.LongType()
_DATA = T.StructType([
    T.StructField("role", T.StringType()), T.StructField("providerID", T.StringType()), T.StructField("modelID", T.StringType()),
    T.StructField("time", T.StructType([T.StructField("created", _COUNT), T.StructField("completed", _COUNT)])), T.StructField("cost", T.DoubleType()), T.StructField("finish", T.StringType()),
    T.StructField("tokens", T.StructType([
        T.StructField("input", _COUNT), T.StructField("output", _COUNT), T.StructField("reasoning", _COUNT), T.StructField("total", _COUNT),
        T.StructField("cache", T.StructType([T.StructField("read", _COUNT), T.StructField("write", _COUNT)])),
    ])),
])


def due(sessions: DataFrame, messages: DataFrame, watermarks: DataFrame, seen: DataFrame, cutoff_ms: int) -> DataFrame:
    """Messages of sessions that changed, up to the cutoff, one row an id (the last update), with ``account`` and ``needs_parts``.

    ``sessions``: session, updated_ms; ``messages``: session, message, role, created_ms, updated_ms and more. A message
    that needs no parts brings its stored ``was_print``.
    """
    s = sessions.join(watermarks.select("session", "watermark_ms", F.col("updated_ms").alias("was_ms")), "session", "left")
    s = s.filter(F.col("was_ms").isNull() | ~F.col("was_ms").eqNullSafe(F.col("updated_ms"))).select("session", "watermark_ms")
    rest = [c for c in messages.columns if c not in ("session", "message")]
    m = messages.filter((F.col("created_ms") >= 0) & (F.col("created_ms") <= cutoff_ms))
    m = m.groupBy("session", "message").agg(F.max_by(F.struct(*rest), F.struct("updated_ms", "created_ms")).alias("r")).select("session", "message", "r.*")
    m = m.join(s, "session").join(seen.select("session", "message", F.col("print").alias("was_print"), F.col("updated_ms").alias("seen_ms"), F.col("partial").alias("was_partial")), ["session", "message"], "left")
    again = F.col("was_print").isNull() | ~F.col("seen_ms").eqNullSafe(F.col("updated_ms")) | F.coalesce("was_partial", F.lit(False))
    account = again | F.col("watermark_ms").isNull() | (F.col("created_ms") >= F.col("watermark_ms"))
    return m.withColumns({"account": account, "needs_parts": again | (F.col("role") == "user")}).drop("seen_ms", "was_partial")


def with_parts(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages with a print of their parts (in the order of their ids), how many there are, and whether all are plain text.

    ``parts``: session, message, part, data. Only parts of messages that need them are read further than the join.
    """
    wanted = parts.join(messages.filter("needs_parts").select("session", "message"), ["session", "message"], "left_semi")
    keys = F.array_sort(F.json_object_keys("data"))
    plain = (keys == F.array(*map(F.lit, TEXT))) & (F.get_json_object("data", "$.type") == "text") & (F.length(F.get_json_object("data", "$.text")) > 0)
    one = wanted.select("session", "message", "part", kinds.content_print(F.col("data"), IDENTITY).alias("print"), F.coalesce(plain, F.lit(False)).alias("plain"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("part", F.coalesce("print", F.lit("")).alias("print")))), lambda x: x["print"])
    held = one.groupBy("session", "message").agg(F.sha2(F.array_join(told, ","), 256).alias("parts_print"), F.count("*").alias("n_parts"), F.bool_and("plain").alias("plain_parts"))
    return messages.join(held, ["session", "message"], "left")


def normalised(messages: DataFrame) -> DataFrame:
    """Messages (as ``with_parts`` gives them, with their JSON ``data``) with usage, kind of input and print."""
    m = messages.withColumn("d", F.from_json("data", _DATA))
    t = "d.tokens"
    usage = normalise.reasoning_resolved(*[F.col(f"{t}.{c}") for c in ("input", "cache.read", "cache.write", "output", "reasoning", "total")])
    m = m.withColumn("u", F.when((F.col("role") == "assistant") & F.col("account"), usage))
    tokens = F.coalesce(kinds.content_print(F.get_json_object("data", "$.tokens"), IDENTITY), F.lit(""))
    made = fields.joined_id(F.col("role"), F.col("d.providerID"), F.col("d.modelID"), F.col("created_ms"), F.col("d.time.created"), F.col("d.time.completed"), tokens, F.coalesce("parts_print", F.lit("")))
    whole = F.array_sort(F.json_object_keys("data")) == F.array(*map(F.lit, ORDINARY))
    kind = kinds.stored(whole, F.col("n_parts"), F.col("plain_parts"))
    unfinished = (F.col("role") == "assistant") & (F.col("d.time.completed").isNull() | (F.col("u.quality") == "partial"))
    return m.select(
        "session", "message", "role", "created_ms", "updated_ms", "account", "needs_parts", fields.labelled(F.col("d.providerID")).alias("provider"), fields.labelled(F.col("d.modelID")).alias("model"), "u",
        normalise.micro(F.col("d.cost")).alias("cost_micro"), F.col("d.time.created").alias("start_ms"), F.col("d.time.completed").alias("end_ms"),
        F.when(F.col("role") == "user", kind).alias("kind"), F.coalesce(F.when(~F.col("needs_parts"), F.col("was_print")), made).alias("print"), F.coalesce(unfinished, F.lit(False)).alias("partial"),
    )


def remembered(done: DataFrame, sessions: DataFrame, watermarks: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(watermarks, seen) after a run; sessions that the run didn't see, and messages it had no need of, stay as they were."""
    top = done.groupBy("session").agg(F.max("created_ms").alias("top"))
    old = watermarks.select("session", F.col("watermark_ms").alias("was"))
    now = sessions.join(top, "session", "left").join(old, "session", "left").select("session", F.coalesce(F.greatest("top", "was"), F.lit(0)).cast("long").alias("watermark_ms"), "updated_ms")
    marks = watermarks.join(now.select("session"), "session", "left_anti").unionByName(now)
    new = done.select("session", "message", "print", "updated_ms", "partial")
    return marks, seen.join(new.select("session", "message"), ["session", "message"], "left_anti").unionByName(new)
