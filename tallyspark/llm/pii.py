"""Personal data by bootstrapped contextual extraction, by DataFrame functions alone.

Base entities (email, ip, card, phone) are found by pattern: a replacement marks the leftmost matches, and the
lengths of the pieces between the marks give code-point places. They are the seeds. Every identifier-like word (six
characters or more with a digit or @; punctuation around it doesn't count) is an instance. Its lexical patterns are the
one to three words before it, the one to three after it, both neighbours together, its shape (letters as a, digits as 9,
runs of mixed ones as ~), and its shape with either neighbour. Spark scores the graph of patterns and instances in ``ROUNDS``
rounds: a pattern by the share of known instances among all its occurrences; an instance by the noisy-or of the patterns
that count. A pattern counts with a share of ``TRUST`` or more, ``SUPPORT`` different known instances, and a share above
that of seeds among all identifier-like words by ``SURE`` standard errors, so that words which stand before anything tell
nothing. Instances that reach ``TRUST`` become known, and their places in all texts are added as kind ``context``.

Neighbours are looked for within ``NEAR`` characters, up to the next word with a digit or @.

Patterns are made linear for Java: possessive runs, which can't change these matches as what follows a run is never
in its class, and starts only where a run begins or the last match ended.

A null text counts as empty. Rows, repeated ones and null ids too, keep one result each. Other columns are ignored
by ``digest`` and kept by ``mask``. Very long texts are searched whole; only the shape of an identifier is taken from its
first 64 characters. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
SUPPORT, TRUST, SURE, ROUNDS, BROADCAST_ROWS, NEAR = 5, 0.6, 3.0, 2, 20_000, 120
MARK, PLAIN, WHITE = "\u0001", "\u0002", "\t\n\x0b\f\r"
_LOCAL = r"[A-Za-z0-9._%+-]"
_FIND = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the entity.
_HINT = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_IDENTIFIER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_LEADING = r"^[^\p{L}\p{N}@]+"
_AROUND = _LEADING + r"|[^\p{L}\p{N}@]+$"
SPAN = "array<struct<s:int,e:int>>"
OCCURRENCE = "array<struct<s:int,e:int,value:string,l:array<string>,r:array<string>>>"


def _starts(lengths: Column) -> Column:
    """Sums of all lengths before each; in blocks of 256, so that no array is copied as often as it is long."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 256).cast("int")), lambda g: F.slice(lengths, g * 256 + 1, 256))
    add = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    firsts = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.array(F.lit(0)), add)
    return F.flatten(F.transform(blocks, lambda b, g: F.slice(F.aggregate(b, F.array(F.get(firsts, g)), add), 1, F.size(b))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = _digits(x)
    n = F.length(d)
    value = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i)))
    return n.between(13, 19) & (F.when(n.between(13, 19), total) % 10 == 0)


_HOLDS = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)),
    "card": _luhn,
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
}


def _marked(docs: DataFrame, name: str, pattern: str, hint: str) -> DataFrame:
    """Adds ``name``, the pieces between marks (odd ones are matches), and ``name_at``, where each begins; null if none."""
    pieces = F.split(F.regexp_replace("t", pattern, f"{MARK}$0{MARK}"), MARK)
    docs = docs.withColumn(name, F.when(F.col("t").rlike(hint), pieces))
    docs = docs.withColumn(name, F.when(F.size(name) > 1, F.col(name)))
    docs = docs.withColumn(f"{name}_n", F.transform(name, lambda p: F.length(p)))
    return docs.withColumn(f"{name}_at", F.when(F.col(name).isNotNull(), _starts(F.col(f"{name}_n"))))


def _odd(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.sequence(F.lit(1), F.size(name) - 2, F.lit(2)))


def base(docs: DataFrame, occurrences: bool = True) -> DataFrame:
    """``docs`` with a span array for each kind, and identifier-like words with the word before them."""
    d = docs.withColumn("t", F.translate(F.coalesce("text", F.lit("")), MARK, PLAIN))
    for kind in KINDS:
        d = _marked(d, "m", _FIND[kind], _HINT[kind])
        places = F.filter(_odd("m"), lambda i: _HOLDS[kind](F.get("m", i)))
        spans = F.transform(places, lambda i: F.struct(F.get("m_at", i).alias("s"), (F.get("m_at", i) + F.get("m_n", i)).alias("e")))
        d = d.withColumn(kind, F.coalesce(spans, F.array().cast(SPAN))).drop("m", "m_n", "m_at")
    if occurrences:
        d = _marked(d, "m", _IDENTIFIER, "[0-9@]")
        words = lambda x: F.filter(F.split(F.lower(F.translate(x, WHITE, " " * len(WHITE))), " "), lambda w: w != "")
        left = lambda i: words(F.right(F.get("m", i - 1), F.lit(NEAR)))
        right = lambda i: words(F.left(F.get("m", i + 1), F.lit(NEAR)))
        tail = lambda w: F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3))
        lead = lambda i: F.length(F.get("m", i)) - F.length(F.regexp_replace(F.get("m", i), _LEADING, ""))
        core = lambda i: F.regexp_replace(F.get("m", i), _AROUND, "")
        # Both ends name m_at: what a lambda names once is worked out in it anew for each of its elements.
        found = F.transform(_odd("m"), lambda i: F.struct((F.get("m_at", i) + lead(i)).alias("s"), (F.get("m_at", i) + lead(i) + F.length(core(i))).alias("e"), F.lower(core(i)).alias("value"), tail(left(i)).alias("l"), F.slice(right(i), 1, 3).alias("r")))
        found = F.filter(found, lambda o: o["e"] - o["s"] >= 6)
        d = d.withColumn("occ", F.coalesce(found, F.array().cast(OCCURRENCE))).drop("m", "m_n", "m_at")
    return d.drop("t")


def patterns(o: Column) -> Column:
    """The lexical patterns of an occurrence."""
    left, right = o["l"], o["r"]
    shape = F.regexp_replace(F.regexp_replace(F.left(o["value"], F.lit(64)), r"\p{L}+", "a"), "[0-9]", "9")
    shape = F.left(F.regexp_replace(shape, "a?(?:9++a){3,}+9*+", "~"), F.lit(40))
    before = [F.when(F.size(left) >= k, F.concat(F.lit("L "), F.array_join(F.slice(left, -k, k), " "))) for k in (1, 2, 3)]
    after = [F.when(F.size(right) >= k, F.concat(F.lit("R "), F.array_join(F.slice(right, 1, k), " "))) for k in (1, 2, 3)]
    both = F.concat(before[0], F.lit(" "), after[0])
    return F.array_compact(F.array(*before, *after, both, F.concat(F.lit("S "), shape), F.concat(before[0], F.lit(" S "), shape), F.concat(after[0], F.lit(" S "), shape)))


def discovered(found: DataFrame) -> DataFrame:
    """(rid, added): places of instances that high-confidence patterns discovered. ``found``: base() with rid."""
    known = F.concat(*KINDS)
    seed = lambda o: F.exists(known, lambda k: (k["s"] < o["e"]) & (o["s"] < k["e"]))
    each = found.select("rid", F.explode(F.transform("occ", lambda o: F.struct(o["s"].alias("s"), o["e"].alias("e"), o["value"].alias("value"), seed(o).alias("seed"), patterns(o).alias("patterns")))).alias("o")).select("rid", "o.*")
    edges = common.cut(each.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    able = edges.groupBy("pattern").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.max("seed").alias("seed")).filter(F.col("seed") & (F.col("size") >= SUPPORT))
    able = common.cut(able.select("pattern", "size", "total", F.col("size").alias("k")))
    if able.isEmpty():
        return found.select("rid").limit(0).withColumn("added", F.array().cast(SPAN))
    graph = common.cut(common.spread(edges, able, ["pattern"]))
    values = common.cut(graph.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"), F.max("seed").alias("seed"), F.count("*").alias("size")))
    all_, seeds = each.agg(F.count("*"), F.sum(F.col("seed").cast("long"))).first()
    usual = (seeds + 1) / (all_ + 2)
    enough = F.greatest(F.lit(TRUST), usual + SURE * F.sqrt(usual * (1 - usual) / F.col("size")))
    for _ in range(ROUNDS):
        sure = common.cut(values.filter(F.col("score") >= TRUST).select("value", "score", "size"))
        share = F.sum(F.col("n") * F.col("score")) / (F.first("total") + 2)
        trusted = common.spread(graph, sure, ["value"]).groupBy("pattern").agg(share.alias("p"), F.count("*").alias("seen"), F.first("k").alias("size"))
        trusted = common.cut(trusted.filter((F.col("seen") >= SUPPORT) & (F.col("p") >= enough)).select("pattern", "p", "size"))
        reached = common.spread(graph.select("pattern", "value"), trusted, ["pattern"]).groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("now"))
        values = common.cut(values.join(reached, "value", "left").select("value", F.greatest("score", F.coalesce("now", F.lit(0.0))).alias("score"), "seed", "size"))
    new = values.filter(~F.col("seed") & (F.col("score") >= TRUST)).select("value")
    places = each.filter("not seed").select("rid", "s", "e", "value").join(common.small(new, BROADCAST_ROWS), "value", "left_semi")
    return places.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("added"))  # places of one text


def _told(kind: str, spans: str) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans, all spans, how many the method added, and whether there is any."""
    common.prepare(docs.sparkSession)
    d = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    found = common.cut(base(d).drop("text"))
    more = common.cut(discovered(found))
    told = F.concat(*[_told(k, k) for k in KINDS])
    out = found.withColumn("told", told)
    if more.isEmpty():
        out = out.withColumns({"all": F.col("told"), "n_context": F.lit(0)})
    else:
        out = out.join(more, "rid", "left").withColumns({"all": F.concat("told", F.coalesce(_told("context", "added"), F.array().cast("array<string>"))), "n_context": F.coalesce(F.size("added"), F.lit(0))})
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join("told", ","), 256).alias("base_sha256"), F.array_join("all", ",").alias("spans"), F.col("n_context").cast("long").alias("n_context"), (F.size("all") > 0).alias("found"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with each entity of the text replaced by its kind in brackets; where entities meet, by the first's."""
    common.prepare(docs.sparkSession)
    names = docs.columns
    key = F.sha2("text", 256).alias("rid")  # equal texts have equal places
    more = common.cut(discovered(common.cut(base(docs.select(key, "text")).drop("text"))))
    d = base(docs.select(F.struct(*names).alias("_row"), "text", key), occurrences=False)
    of = lambda spans, kind: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k")))
    spans = [of(k, k) for k in KINDS]
    if not more.isEmpty():
        d = d.join(more, "rid", "left").withColumn("added", F.coalesce("added", F.array().cast(SPAN)))
        spans.append(of("added", "context"))
    d = d.withColumn("spans", F.array_sort(F.concat(*spans)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    gap = lambda a, x: F.when(x["s"] >= a["at"], F.concat(F.substr("text", a["at"] + 1, x["s"] - a["at"]), F.lit("["), F.upper(x["k"]), F.lit("]"))).otherwise("")
    step = lambda a, x: F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], F.array(gap(a, x))).alias("out"))
    end = lambda a: F.concat(F.array_join(a["out"], ""), F.substr("text", a["at"] + 1, F.length("text")))
    text = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, end)).otherwise(F.col("text"))
    return d.select(*[(text if c == "text" else F.col(f"_row.{c}")).alias(c) for c in names])
