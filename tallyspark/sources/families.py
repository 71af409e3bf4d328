"""Three layouts of JSON-lines history as facts. Input: (path, offset, line) of whole lines, as ``ledger_jsonl`` gives them.

Fields are taken by typed projection, numbers only; what a line lacks is null. State within a file (its session, the
turn that later lines belong to) is a window over the file's order; a file is one history, so windows are bounded.
Envelope lines are counted and dealt by ``LINES``, so what a task sorts doesn't grow with the input, only with its largest file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields
from ..operators import dedup, kinds
from . import normalise

FACTS = ("agent", "origin", "session", "workspace", "turn", "at_ms", "provider", "model", "uncached", "cache_read", "cache_write", "output", "reasoning", "total", "quality", "reasons")


def _text(path: str) -> Column:
    return F.get_json_object("line", f"$.{path}")


def _number(path: str) -> Column:
    """A JSON number without a fraction; numeric text isn't one."""
    v = f"try_variant_get(try_parse_json(line), '$.{path}', 'variant')"
    return F.expr(f"CASE WHEN schema_of_variant({v}) = 'BIGINT' THEN cast({v} AS bigint) END")


def _at(path: str) -> Column:
    n = _number(path)
    return fields.instant(F.when(n.isNull(), _text(path)), n)


def _facts(df: DataFrame, agent: str, usage: Column) -> DataFrame:
    return df.withColumn("u", usage).select(F.lit(agent).alias("agent"), *FACTS[1:8], *[F.col(f"u.{c}").alias(c) for c in FACTS[8:]])


_NAMES = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
_PARTS = ("uncached", "cache_read", "cache_write", "output", "reasoning", "total")
_USAGE = "struct<" + ", ".join(f"{n}: bigint" for n in _NAMES) + ">"
#: All of an envelope line that any fact needs; each line is parsed once, to this.
_ENVELOPE = f"""timestamp string, ordinal bigint, type string, payload struct<id: string, session_id: string, cwd: string, model_provider: string, origin_session_id: string, root_session_id: string,
  previousSessionFiles: array<string>, originator: string, turn_id: string, model: string, response_id: string, thread_id: string, type: string, role: string, usage: {_USAGE}, info: struct<total_token_usage: {_USAGE}>,
  item: struct<id: string, type: string, name: string, started_at_ms: bigint, completed_at_ms: bigint>, internal_chat_message_metadata_passthrough: struct<content_item_kinds: array<string>>>"""
CONTROLLER = 128
#: About so many envelope lines are one task's. Parsed lines take some forty times the bytes they were shuffled in, by which Spark would size tasks.
LINES = 100_000


def _instant(text: Column) -> Column:
    """Of a time as text: digits are milliseconds."""
    return fields.instant(F.when(~text.rlike("^[0-9]+$"), text), F.when(text.rlike("^[0-9]{1,16}$"), text.cast("bigint")))


def _dealt(lines: DataFrame) -> DataFrame:
    """``lines`` by whole files, in as many parts as their number asks for; this counts them."""
    return lines.repartition(max(lines.count() // LINES + 1, lines.sparkSession.sparkContext.defaultParallelism), "path")


def envelopes(lines: DataFrame, rollouts: DataFrame | None = None) -> DataFrame:
    """Parsed lines with what those before them in the file say: session, the session it goes on, turn, model and folder.

    ``rollouts`` (path, session): which session an earlier file holds, so that a file naming it goes on that session.
    """
    p = _dealt(lines).select("path", "offset", F.from_json("line", _ENVELOPE).alias("r")).select("path", "offset", _instant(F.col("r.timestamp")).alias("at_ms"), "r.ordinal", "r.type", F.col("r.payload").alias("p"))
    kind = F.col("type")
    turn = F.when(kind == "turn_context", F.struct(F.col("p.turn_id").alias("turn"), F.coalesce("p.model", F.lit("unknown")).alias("model")))
    before = F.coalesce("p.previousSessionFiles", F.array().cast("array<string>"))
    meta = F.when(kind == "session_meta", F.struct(
        F.coalesce("p.id", "p.session_id").alias("id"), F.coalesce("p.model_provider", F.lit("unknown")).alias("provider"), F.coalesce("p.origin_session_id", "p.root_session_id").alias("of"), before.alias("before"),
        F.when(F.length("p.originator").between(1, CONTROLLER), F.col("p.originator")).alias("controller"),
    ))
    order = Window.partitionBy("path").orderBy("offset")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = p.withColumns({"t": turn, "place": F.when(kind.isin("turn_context", "session_meta"), F.col("p.cwd")), "meta": meta, "opens": kind == "session_meta"})
    p = p.withColumns({"t": F.last("t", True).over(so_far), "workspace": F.last("place", True).over(so_far), "meta": F.first("meta", True).over(whole), "opens": F.first("opens").over(whole)})
    p = p.withColumn("complete", F.coalesce(F.col("opens") & (F.size("meta.before") == 0), F.lit(False)))
    if rollouts is None:
        told = F.lit(None).cast("string")
    else:
        named = p.filter(kind == "session_meta").select("path", F.posexplode("meta.before").alias("nth", "named")).join(rollouts.select(F.col("path").alias("named"), F.col("session").alias("went")), "named")
        p, told = p.join(named.groupBy("path").agg(F.min_by("went", "nth").alias("went")), "path", "left"), F.col("went")
    session = F.coalesce("meta.id", "path")
    return p.select(
        "path", "offset", "at_ms", "ordinal", "type", "p", "complete", session.alias("session"), F.coalesce("meta.of", told, session).alias("of"), "workspace", F.col("t.turn").alias("turn"), F.coalesce("meta.provider", F.lit("unknown")).alias("provider"),
        F.coalesce("t.model", F.lit("unknown")).alias("model"), "meta.controller",
    )


_PLACE = ("session", "workspace", "turn", "at_ms", "provider", "model")


def envelope_usage(lines: DataFrame, agent: str = "codex", rollouts: DataFrame | None = None) -> DataFrame:
    """Usage of ``{timestamp, type, payload}`` lines.

    A record belongs to the last turn before it; a turn without a model resets it to unknown, one without a folder
    keeps the last. Running totals are checkpoints: what they grew by since the last one, beyond the records between the
    two (each origin once), is billed as a remainder; so a file with totals alone is billed by their growth. The first
    total is compared with the records before it where the file begins with its session and names no earlier files,
    else it is a baseline of unknown history. A total that falls in any counter begins a new epoch and bills nothing;
    a remainder that isn't positive, or less than the records in any counter, is left out. ``envelope_gaps`` counts these.

    Copies of a session in several files meet: a record is known by its provider and response, without a response by
    thread, turn, ordinal, time and counts; a remainder by the session that the file goes on, epoch, ordinal, time and growth.
    """
    p = envelopes(lines, rollouts)
    rows = p.filter("type = 'token_usage_record'").withColumns({"provider": F.coalesce("p.model_provider", "provider"), "model": F.coalesce("p.model", "model"), "turn": F.coalesce("p.turn_id", "turn")})
    rows = rows.withColumn("u", normalise.inclusive_input(*[F.col(f"p.usage.{n}") for n in _NAMES]))
    new = rows.select(_record_id(agent).alias("origin"), *_PLACE, *[F.col(f"u.{c}").alias(c) for c in _PARTS], "u.quality", "u.reasons").select(F.lit(agent).alias("agent"), *FACTS[1:])
    rest = _remainders(_checkpoints(p, agent), agent).filter("state = 'billed'").drop("path", "state", "epoch")
    return dedup.best(new.unionByName(rest), ["origin"], F.desc(F.when(F.col("quality") == "recorded", 1).otherwise(0)), F.asc_nulls_last("at_ms"), F.asc("session"))


def _record_id(agent: str) -> Column:
    counts = [F.col(f"u.{c}") for c in _PARTS]
    loose = fields.joined_id(F.lit(agent), F.lit("event"), F.coalesce("p.thread_id", "of"), F.col("turn"), F.col("ordinal"), F.col("at_ms"), *counts)
    return F.when(F.col("p.response_id").isNotNull(), fields.joined_id(F.lit(agent), F.lit("response"), F.col("provider"), F.col("p.response_id"))).otherwise(loose)


def envelope_gaps(lines: DataFrame, agent: str = "codex") -> DataFrame:
    """(path, state, checkpoints, epochs): what became of each file's running totals: billed, even, unallocated-history, counter-discontinuity, parse-gap."""
    told = _remainders(_checkpoints(envelopes(lines), agent), agent)
    return told.groupBy("path", "state").agg(F.count("*").alias("checkpoints"), (F.max("epoch") + 1).alias("epochs"))


def _checkpoints(p: DataFrame, agent: str) -> DataFrame:
    """A row for each running total: its counters, those of the one before (``was_``), and the sums of records between (``mid_``, null if one is unknown)."""
    record = F.col("type") == "token_usage_record"
    total = (F.col("type") == "event_msg") & (F.col("p.type") == "token_count") & F.col("p.info.total_token_usage").isNotNull()
    told = [F.when(record, F.col(f"p.usage.{n}")).otherwise(F.col(f"p.info.total_token_usage.{n}")) for n in _NAMES]
    r = p.withColumns({"is_record": record, "turn_": F.coalesce("p.turn_id", "turn"), "by": F.coalesce("p.model_provider", "provider")}).filter(record | total).withColumn("u", normalise.inclusive_input(*told))
    r = r.withColumn("id", F.when(F.col("is_record"), _record_id(agent)).otherwise(F.col("offset").cast("string")))
    r = r.select("path", "offset", "complete", "is_record", "id", "of", "ordinal", *_PLACE, *[F.col(f"u.{c}").alias(c) for c in _PARTS]).filter("is_record or " + " or ".join(f"{c} is not null" for c in _PARTS))
    r = r.withColumn("nth", F.row_number().over(Window.partitionBy("path", "is_record", "id").orderBy("offset"))).filter("nth = 1").drop("nth", "id")
    order = Window.partitionBy("path").orderBy("offset")
    r = r.withColumn("segment", F.count(F.when(~F.col("is_record"), 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    of, segment = F.col("is_record"), Window.partitionBy("path", "segment")
    mid = {c: F.when(F.count(F.when(of & F.col(c).isNull(), 1)).over(segment) == 0, F.coalesce(F.sum(F.when(of, F.col(c))).over(segment), F.lit(0))) for c in _PARTS}
    r = r.withColumns({f"mid_{c}": x for c, x in mid.items()}).filter(~of)
    return r.withColumns({**{f"was_{c}": F.lag(c).over(order) for c in _PARTS}, "begins": F.row_number().over(order) == 1})


def _remainders(checkpoints: DataFrame, agent: str) -> DataFrame:
    """Facts of what checkpoints tell beyond records, with ``path``, ``state`` and the counter's ``epoch``."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    some = lambda f: F.array_contains(F.array(*[yes(f(c)) for c in _PARTS]), True)
    grown = {c: F.when(F.col("begins"), F.col(c)).otherwise(F.col(c) - F.col(f"was_{c}")) for c in _PARTS}
    c = checkpoints.withColumns({"fell": ~F.col("begins") & some(lambda c: F.col(c) < F.col(f"was_{c}")), **{f"grown_{c}": x for c, x in grown.items()}})
    c = c.withColumn("epoch", F.sum(F.col("fell").cast("int")).over(Window.partitionBy("path").orderBy("offset")))
    rest = {c: F.when(F.col(f"grown_{c}") >= F.col(f"mid_{c}"), F.col(f"grown_{c}") - F.col(f"mid_{c}")) for c in _PARTS}
    state = (
        F.when(F.col("begins") & ~yes(F.col("complete")), "unallocated-history").when(F.col("fell"), "counter-discontinuity")
        .when(some(lambda c: F.col(f"mid_{c}") > F.col(f"grown_{c}")), "parse-gap").when(some(lambda c: F.col(f"rest_{c}") > 0), "billed").otherwise("even")
    )
    origin = fields.joined_id(F.lit(agent), F.lit("total"), F.col("of"), F.col("epoch"), F.col("ordinal"), F.col("at_ms"), *[F.col(f"grown_{k}") for k in _PARTS])
    c = c.withColumns({f"rest_{k}": x for k, x in rest.items()}).withColumns({"state": state, "origin": origin})
    whole = F.forall(F.array(*[F.col(f"rest_{k}") for k in _PARTS]), lambda x: x.isNotNull())
    reasons = F.array_compact(F.array(F.when(~whole, "parse-gap"), F.when(F.col("at_ms").isNull(), "unallocated-history")))
    made = c.select("path", "state", "epoch", F.lit(agent).alias("agent"), "origin", *_PLACE, *[F.col(f"rest_{k}").alias(k) for k in _PARTS], reasons.alias("reasons"))
    return made.withColumn("quality", F.when(F.size("reasons") == 0, "recorded").otherwise("partial"))


def envelope_work(lines: DataFrame, agent: str = "codex") -> DataFrame:
    """Closed, positive intervals of completed items; copies of a session meet by session, item, type and times."""
    i = envelopes(lines).filter("type = 'event_msg' and p.type = 'item_completed'")
    kind, name = fields.item_type(F.col("p.item.type")), fields.item_type(F.col("p.item.name"))
    origin = fields.joined_id(F.lit(agent), F.lit("item"), F.col("of"), F.coalesce("p.item.id", F.col("ordinal").cast("string")), F.col("p.item.type"), F.col("p.item.started_at_ms"), F.col("p.item.completed_at_ms"))
    i = i.select(F.lit(agent).alias("agent"), "path", "session", origin.alias("origin"), F.col("p.item.started_at_ms").alias("start_ms"), F.col("p.item.completed_at_ms").alias("end_ms"), kind.alias("kind"), name.alias("name"))
    return i.filter("end_ms > start_ms and kind <> 'excluded'").drop("name").dropDuplicates(["origin"])


def envelope_inputs(lines: DataFrame, parents: DataFrame | None = None, agent: str = "codex") -> DataFrame:
    """Submitted and other user messages, one observation a line, as ``merge.merged`` takes them; ``parents``: session, parent.

    A message without an id can't be told from its copies and is left out.
    """
    m = envelopes(lines).filter("type = 'response_item' and p.type = 'message' and p.role = 'user' and p.id is not null")
    kind = kinds.envelope(F.coalesce("p.internal_chat_message_metadata_passthrough.content_item_kinds", F.array().cast("array<string>")))
    up = F.lit(None).cast("string")
    if parents is not None:
        m, up = m.join(parents.select("session", "parent").dropDuplicates(["session"]), "session", "left"), F.col("parent")
    unknown = kind == "unknown"
    return m.select(
        fields.joined_id(F.lit(agent), F.lit("input"), F.col("p.id")).alias("origin"), F.lit(False).alias("retained"), F.struct("path", "offset").alias("ordinal"), F.lit(agent).alias("agent"), "session", F.col("session").alias("native_session"),
        F.col("p.id").alias("native_input"), F.lit(agent).alias("source"), F.coalesce("workspace", F.concat_ws(":", F.lit(agent), F.lit("unattributed"), "session")).alias("workspace"), "at_ms", kind.alias("kind"), kinds.lane(up).alias("lane"),
        F.when(unknown, "partial").otherwise("recorded").alias("quality"), F.when(unknown, F.array(F.lit("input-kind-unknown"))).otherwise(F.array().cast("array<string>")).alias("reasons"), F.lit("unknown").alias("by_whom"), F.lit("none").alias("evidence"), "controller",
    )


def flat_usage(lines: DataFrame, agent: str = "claude") -> DataFrame:
    """Usage of flat ``{type, sessionId, requestId, message}`` lines: of a response's revisions the latest complete one."""
    a = lines.filter(_text("type") == "assistant")
    u = "message.usage."
    a = a.select(
        fields.joined_id(F.lit(agent), _text("requestId"), _text("message.id")).alias("origin"), _text("sessionId").alias("session"), _text("cwd").alias("workspace"), F.lit(None).cast("string").alias("turn"), _at("timestamp").alias("at_ms"),
        F.lit("anthropic").alias("provider"), fields.labelled(_text("message.model")).alias("model"), "path", "offset",
        normalise.disjoint(_number(u + "input_tokens"), _number(u + "cache_read_input_tokens"), _number(u + "cache_creation_input_tokens"), _number(u + "output_tokens"), _number(u + "output_tokens_details.thinking_tokens")).alias("u"),
    )
    first = a.groupBy("origin").agg(F.min(F.struct(F.coalesce("at_ms", F.lit(2**53)).alias("at"), "path", "offset", "session", "workspace")).alias("f"), F.min("at_ms").alias("first_ms"))
    best = dedup.best(a, ["origin"], F.desc(F.when(F.col("u.quality") == "recorded", 1).otherwise(0)), F.desc(F.coalesce("at_ms", F.lit(-1))), F.desc("path"), F.desc("offset"))
    j = best.drop("session", "workspace", "at_ms").join(first, "origin").withColumns({"session": F.col("f.session"), "workspace": F.col("f.workspace"), "at_ms": F.col("first_ms")})
    return _facts(j.drop("f"), agent, F.col("u"))


def headed_usage(lines: DataFrame, agent: str = "omp") -> DataFrame:
    """Usage of files with a session header: a response that several files of a family hold counts once, for the first session."""
    order = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first(F.when(_text("type") == "session", F.struct(_text("id").alias("id"), _text("cwd").alias("cwd"), _at("timestamp").alias("at"))), True).over(order)
    p = lines.withColumn("head", head)
    m = p.filter((_text("type") == "message") & (_text("message.role") == "assistant"))
    u = "message.usage."
    rows = m.select(
        fields.joined_id(F.lit(agent), F.coalesce(_text("message.responseId"), F.concat_ws("@", "path", "offset"))).alias("origin"), F.col("head.id").alias("session"), F.col("head.cwd").alias("workspace"), _text("parentId").alias("turn"), _at("timestamp").alias("at_ms"),
        fields.labelled(_text("message.provider")).alias("provider"), fields.labelled(_text("message.model")).alias("model"), F.col("head.at").alias("began"), "path", "offset",
        normalise.with_residual(*[_number(u + n) for n in ("input", "cacheRead", "cacheWrite", "output", "reasoningTokens", "totalTokens")]).alias("u"),
    )
    one = dedup.best(rows, ["origin"], F.asc_nulls_last("began"), F.asc("path"), F.asc("offset"))
    return _facts(one, agent, F.col("u"))

