"""The cadence cohort: exclusions that exclude each other, clipped and united work."""

from tallyspark.operators import inputs

ROWS = "agent string, session string, source string, at_ms long, kind string, lane string, decision string, quality string"
CUTOFF = 1_788_955_200_000
AT = CUTOFF - 86_400_000


def row(session, at=AT, kind="submission", lane="main", decision="included", quality="recorded", source="codex"):
    return ("codex", session, source, at, kind, lane, decision, quality)


def told(spark, rows, work, usable=True):
    states = spark.createDataFrame([("codex", usable), ("other", False)], "source string, usable boolean")
    ranges = spark.createDataFrame([(7, CUTOFF - 7 * 86_400_000, CUTOFF), (0, CUTOFF - 1000, CUTOFF)], "days int, from_ms long, to_ms long")
    out = inputs.cadence(spark.createDataFrame(rows, ROWS), states, spark.createDataFrame([("codex", *w) for w in work], "agent string, session string, start_ms long, end_ms long"), ranges, "UTC")
    return {(r.days, r.state): (r.sessions, r.inputs, r.work_ms) for r in out.collect()}


def test_each_session_has_one_state(spark):
    rows = [
        row("good"), row("good", AT + 300_000), row("good", AT + 420_000), row("history", quality="partial"), row("history", AT + 1, decision="out-of-scope"), row("mixed"), row("mixed", AT + 1, decision="unattributed"),
        row("undated"), row("undated", None), row("old"), row("old", AT - 8 * 86_400_000, kind="unknown"), row("quiet"), row("quiet", None, kind="replay"), row("quiet", kind="context", decision="out-of-scope"), row("lost", source="other"), row("never"), row("side", lane="subagent"),
    ]
    long = 7_200_000
    work = [("good", AT - 600_000, AT), ("good", AT, AT + 600_000), ("good", AT + 120_000, AT + 480_000), ("good:child", AT, AT + long), ("history", AT, AT + 9), ("mixed", AT, AT + 9), ("old", AT - 50, AT + long), ("quiet", CUTOFF - 60_000, CUTOFF + long), ("side", AT, AT + 9)]
    assert told(spark, rows, work) == {(7, "measured"): (3, 5, 600_000 + long + 60_000), (7, "input-history"): (3, 3, None), (7, "mixed-scope"): (1, 1, None), (7, "no-recorded-work"): (1, 1, None)}


def test_lanes_are_united_and_sessions_added(spark):
    rows = [row("a"), row("b"), row("b", AT + 60_000)]
    work = [("a", AT, AT + 600_000), ("a", AT + 120_000, AT + 480_000), ("b", AT, AT + 600_000)]
    assert told(spark, rows, work) == {(7, "measured"): (2, 3, 1_200_000)}


def test_a_source_without_usable_state(spark):
    assert told(spark, [row("a")], [("a", AT, AT + 5)], usable=False) == {(7, "input-history"): (1, 1, None)}
