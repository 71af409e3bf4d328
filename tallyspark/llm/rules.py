"""Quality rules as a bitmask ledger, by DataFrame functions alone.

``ledger`` measures each whole text once and stores the measurements with a bit for each failed rule. A policy is a
version's mask of rules; ``apply`` keeps what fails none of them, and ``ablation`` tells, by bitwise aggregation over
the ledger alone, how many texts each rule rejects, rejects alone, and how many a policy without it would keep.

Words are split at white space. A null or blank text has no words and fails ``few_words``. Rows, repeated ones too,
are handled one by one without a shuffle; a null doc_id keeps its row; other columns are ignored. Very long texts are
measured whole; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WHITE, SYMBOLS, WINDOW = " \t\n\x0b\f\r", "#*$%&|<>", 5
#: Rule: what fails it. A rule's bit is its place; places never change, new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 5 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars > 15 * n_words or word_chars < 2 * n_words",
    "capitals": "2 * n_upper > word_chars",
}
BASE = ("few_words", "repeated_words")
#: Policies by version, as the rules they apply.
POLICIES: dict[int, tuple[str, ...]] = {1: BASE, 2: tuple(RULES)}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: tuple[str, ...]) -> int:
    return sum(bit(r) for r in rules)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id with every measurement. Each step is a projection of its own, so nothing is worked out twice."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("t"), F.btrim(text, F.lit(WHITE)).alias("trimmed"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "t",
        F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", r"[\x20\x09-\x0D]+")).alias("w"),
        lines.alias("lines"),
        (F.length("t") - F.length(F.translate("t", WHITE, ""))).alias("blank"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).alias("n_upper"),
    )
    d = d.select(
        "doc_id", F.size("w").alias("n_words"), (F.length("t") - F.col("blank")).alias("word_chars"), "n_symbols", "n_upper",
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    d = d.withColumn("s", F.when(F.col("n_words") >= WINDOW, windows)).drop("h")
    # Windows found again: sorted with their places, equal neighbours stand together. Only for texts that repeat any.
    d = d.withColumn("r", F.when(F.size(F.array_distinct("s")) < F.size("s"), F.array_sort(F.transform("s", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("s")
    same = lambda e, j: (F.coalesce(F.get("r", j - 1)["x"] == e["x"], F.lit(False))) | (F.coalesce(F.get("r", j + 1)["x"] == e["x"], F.lit(False)))
    d = d.withColumn("p", F.array_sort(F.transform(F.filter("r", same), lambda e: e["i"]))).drop("r")
    covered = F.aggregate(F.transform("p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("p", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("p")
    return d.select("doc_id", *[F.col(c).cast("long").alias(c) for c in d.columns[1:]])


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed``, a bit for each rule that the text fails."""
    m = measured(docs)
    return m.withColumn("failed", reduce(Column.bitwiseOR, [F.when(F.expr(fails), F.lit(bit(rule))).otherwise(F.lit(0)) for rule, fails in RULES.items()]).cast("long"))


def fails(policy: tuple[str, ...]) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) != 0


def apply(book: DataFrame, version: int) -> DataFrame:
    return book.withColumns({"base_failed": fails(BASE), "kept": ~fails(POLICIES[version])})


def ablation(book: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: texts it rejects, those only it rejects, and what the policy keeps without it."""
    policy = POLICIES[version]
    hit = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    counts = book.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))  # a row for each combination of bits
    per = []
    for rule in policy:
        b = F.lit(bit(rule))
        per.append(counts.agg(
            F.lit(rule).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("hit").bitwiseAND(b) != 0, F.col("n"))), F.lit(0)).alias("rejects"),
            F.coalesce(F.sum(F.when(F.col("hit") == b, F.col("n"))), F.lit(0)).alias("rejects_alone"),
            F.coalesce(F.sum(F.when(F.col("hit").bitwiseAND(F.bitwise_not(b)) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
        ))
    return reduce(DataFrame.unionByName, per)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply(ledger(common.table(spark, sf_dir, "documents")), 2)
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l FROM tok),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(l, ' ')) AS n FROM win WHERE len(l) = 5),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS BIGINT) AS n_upper, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 5 * n_words OR 10 * n_dup_lines > 3 * n_lines
    OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 2 * n_upper > word_chars) AS kept
FROM m
"""
