"""Quality by hierarchical empirical Bayes.

A logistic classifier over a text's own measurements gives each document its evidence. Hosts and paths under them get
posterior rates of good labels by grouped sums over the labelled rows outside the held-out fold: a host's rate is shrunk
towards the corpus's, a path's towards its host's, by prior weights fitted to the spread between groups (method of
moments), so sparse sites stay near their prior and sites without labels at it. A document's score shifts its own log odds
by its path's, as far as the path differs from the corpus.

In ``documents`` the host is ``source`` and the path below it ``lang``. Everything here is DataFrame functions and
Spark's own logistic regression over all labelled rows outside the held-out fold; sums reach the driver, rows don't.

Null texts count as empty; null hosts and paths are groups of their own; labels that disagree count by their mean.
Without labels of both kinds the evidence is 0.5. Rows, repeated ones and null ids too, are scored one by one, very long
texts whole. Empty documents give no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, PART, KEEP = 4, 1, 0.5
FEATURES = ("symbols", "capitals", "digits", "same_next", "distinct", "length", "size")


def measured(docs: DataFrame, host: str, path: str) -> DataFrame:
    """doc_id, host, path and the classifier's inputs, each of bounded size."""
    t = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), t.alias("t"), F.split(F.btrim(t, F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+").alias("w"))
    n = F.greatest(F.size("w"), F.lit(1))
    chars = F.greatest(F.length("t"), F.lit(1))
    less = lambda what: F.length("t") - F.length(what)
    return d.select(
        "doc_id", "host", "path",
        F.least(less(F.translate("t", "#*$%&|<>", "")) / n, F.lit(3.0)).alias("symbols"),
        (less(F.regexp_replace("t", r"\p{Lu}+", "")) / chars).alias("capitals"),
        (less(F.translate("t", "0123456789", "")) / chars).alias("digits"),
        (F.size(F.filter("w", lambda x, i: x == F.get("w", i - 1))) / n).alias("same_next"),
        (F.log1p(F.size(F.array_distinct("w"))) - F.log1p(n)).alias("distinct"),
        F.least(F.length("t") / n, F.lit(30.0)).alias("length"),
        F.log1p(n).alias("size"),
    )


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of labelled documents outside the held-out fold; label: 1 good, 0 bad."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    return known.filter(~common.held_out(F.col("doc_id"), PARTS, PART))


def evidence(rows: DataFrame, known: DataFrame) -> Column:
    """A classifier learned from all labelled rows, as a column over FEATURES."""
    train = common.cut(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows.join(known, "doc_id")).select("x", "label"))
    if train.select("label").distinct().count() < 2:
        return F.lit(0.5)
    fitted = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-3, maxIter=40).fit(train)
    z = F.lit(float(fitted.intercept))
    for name, w in zip(FEATURES, fitted.coefficients.toArray()):
        z = z + F.col(name) * float(w)
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _shrunk(groups: DataFrame, prior: str) -> DataFrame:
    """Adds ``rate``: the group's share of good labels shrunk towards ``prior``; the weight makes up for the spread that noise leaves."""
    mean, spread = F.try_divide(F.col("s"), F.col("n")), F.when(F.col("n") > 0, F.col(prior) * (1 - F.col(prior)))
    moments = groups.agg(F.sum(F.col("n") * (mean - F.col(prior)) ** 2).alias("seen"), F.sum(spread).alias("noise"), F.sum(F.col("n") * spread).alias("most"))  # one row
    between = (F.col("seen") - F.col("noise")) / F.greatest("most", F.lit(1e-9))
    weight = moments.select(F.coalesce(1 / F.least(F.greatest(between, F.lit(1e-3)), F.lit(0.5)) - 1, F.lit(10.0)).alias("weight"))
    return groups.crossJoin(F.broadcast(weight)).withColumn("rate", (F.col("s") + F.col("weight") * F.col(prior)) / (F.col("n") + F.col("weight"))).drop("weight")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, held_out, the classifier's evidence, host_rate, path_rate, score and kept."""
    common.prepare(docs.sparkSession)
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    rows = common.cut(measured(docs, host, path).withColumns({"h": key("host"), "p": key("path")}))
    known = common.cut(known_labels(labels))
    rows = rows.withColumn("evidence", evidence(rows, known))
    sums = rows.select("doc_id", "h", "p").join(known, "doc_id", "left").groupBy("h", "p").agg(F.count("*").alias("size"), F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("s"))
    sums = common.cut(sums)
    top = sums.agg(((F.coalesce(F.sum("s"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("top"))  # one row
    hosts = sums.groupBy("h").agg(F.count("*").alias("size"), F.sum("n").alias("n"), F.sum("s").alias("s")).crossJoin(F.broadcast(top))
    hosts = common.cut(_shrunk(common.cut(hosts), "top").select("h", "size", "top", F.col("rate").alias("host_rate")))
    paths = common.cut(common.spread(sums.withColumnRenamed("size", "rows"), hosts, ["h"]))
    paths = common.cut(_shrunk(paths, "host_rate").select("h", "p", F.col("rows").alias("size"), "top", "host_rate", F.col("rate").alias("path_rate")))
    out = common.spread(rows, paths, ["h", "p"])
    z = _logit(F.col("evidence")) + _logit(F.col("path_rate")) - _logit(F.col("top"))
    score = 1 / (1 + F.exp(-z))
    return out.select("doc_id", common.held_out(F.col("doc_id"), PARTS, PART).alias("held_out"), "evidence", "host_rate", "path_rate", score.alias("score"), (score >= KEEP).alias("kept"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
