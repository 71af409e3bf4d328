"""URL filters by a path-template tree, by DataFrame functions alone.

Rules (verdict, host, path) judge what they fit: their host and its subdomains, where the path starts with theirs;
the longest rule wins. What they judge is the labelled part. For the rest a tree is built per host, level by level. Runs
of digits in a path segment become #. A segment stays a branch of its own if it holds ``SHARE`` of its node's urls and
``FEW`` of them; else, and wherever nearly every url of a node has a segment of its own (entropy ``SPREAD``), it falls into the
wildcard branch *. Branches whose next segments look alike - the share of urls that end there, how many there are, their entropy
and length - are merged, and named ~ and the first of them; labelled branches only with labelled ones from whose common
block rate they don't differ by ``Z`` standard errors, unlabelled only with unlabelled. A node of fewer than ``FEW`` urls, or below ``DEEPEST``
segments, is not divided (/**).

A node's prior is the mean block rate of its labelled branches, each counted once, smoothed towards its parent's by
``WEIGHT`` branches; so one branch with many labels says little about those without. A template's purity is its block
rate smoothed towards its node's prior by ``WEIGHT`` labels; a template blocks at ``REJECT`` or more.

Urls are folded to shapes before any level is built, so a host with very many urls stays few rows where they are alike;
node totals are sums of partial sums, and joins on hot nodes are spread. A null url, or one without ://, has an empty
host and path. Rows, repeated ones and null ids too, are handled one by one; other columns are ignored. An empty table
gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEEPEST, SHARE, FEW, SPREAD, Z, WEIGHT, REJECT = 40, 0.01, 5, 0.9, 2.0, 4.0, 0.8


def located(pages: DataFrame) -> DataFrame:
    upper = "".join(map(chr, range(65, 91)))
    at = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    return pages.select("page_id", F.translate(F.regexp_extract(url, at, 1), upper, upper.lower()).alias("host"), F.regexp_extract(url, at, 2).alias("path"))


def ruled(rules=RULES) -> tuple[Column, Column]:
    """The rule that wins, as host and path, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _shapes(path: str) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "#"))


def _prior(rates: Column, above: Column) -> Column:
    """The mean of labelled branches' rates (null: unlabelled), smoothed towards ``above``."""
    return (F.coalesce(F.sum(rates), F.lit(0.0)) + WEIGHT * above) / (F.count(rates) + WEIGHT)


def _rate() -> Column:
    return F.when(F.col("labelled") > 0, (F.col("blocked") + 0.5) / (F.col("labelled") + 1))


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])


def _branches(live: DataFrame, depth: int) -> DataFrame:
    """(node, seg, size, divided, branch, prior) of every node and next segment ('': none) of ``live``."""
    seg, next_ = (F.coalesce(F.get("segs", F.lit(depth + k)), F.lit("")) for k in (0, 1))
    rows = live.select("node", "above", seg.alias("seg"), next_.alias("next"), "n", "labelled", "blocked")
    pairs = rows.groupBy("node", "above", "seg", "next").agg(F.count("*").alias("size"), *[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    more = F.col("next") != ""
    heard = lambda n: n * F.log(n.cast("double"))
    segs = pairs.groupBy("node", "above", "seg").agg(
        *[F.sum(c).alias(c) for c in ("size", "n", "labelled", "blocked")], F.sum(F.when(~more, F.col("n")).otherwise(0)).alias("ends"), F.count(F.when(more, 1)).alias("kids"),
        F.sum(F.when(more, heard(F.col("n"))).otherwise(0.0)).alias("heard"), F.sum(F.when(more, F.col("n") * F.length("next")).otherwise(0)).alias("long"))
    segs = common.cut(segs)
    here = F.col("seg") != ""
    nodes = segs.groupBy("node").agg(
        F.count("*").alias("size"), F.sum("n").alias("all"), F.sum(F.when(here, F.col("n")).otherwise(0)).alias("on"), F.count(F.when(here, 1)).alias("branches"), F.sum(F.when(here, heard(F.col("n"))).otherwise(0.0)).alias("told"))
    even = (F.log("on") - F.col("told") / F.col("on")) / F.greatest(F.log("on"), F.lit(1e-9))
    nodes = nodes.select("node", "size", "all", ((F.col("all") >= FEW) & (F.col("on") > 0)).alias("divided"), F.coalesce((F.col("branches") >= 2 * FEW) & (even >= SPREAD), F.lit(False)).alias("varied"))
    known = common.spread(segs.withColumnRenamed("size", "rows"), common.cut(nodes), ["node"])
    through = F.greatest(F.col("n") - F.col("ends"), F.lit(1))
    steps = lambda x: F.floor(x + 1e-9).cast("string")
    look = F.concat_ws(
        ".", F.when(F.col("labelled") > 0, "l").otherwise("u"), steps(2 * F.col("ends") / F.col("n") + 0.5), steps(F.log1p("kids")),
        steps(F.log(through) - F.col("heard") / through), steps(F.log2(1 + F.col("long") / through)))
    kept = here & ~F.col("varied") & (F.col("n") >= FEW) & (F.col("n") >= SHARE * F.col("all"))
    known = known.withColumns({"kept": kept, "look": F.when(kept, look)})
    # At most 1 / SHARE branches of a node are kept.
    group = Window.partitionBy("node", "look")
    own = known.filter("kept").withColumns({"b": F.sum("blocked").over(group), "l": F.sum("labelled").over(group)})
    rate = (F.col("b") + 0.5) / (F.col("l") + 1)
    alone = (F.col("labelled") > 0) & (F.abs(_rate() - rate) > Z * F.sqrt(rate * (1 - rate) / F.greatest("labelled", F.lit(1))))
    own = own.withColumn("alone", F.coalesce(alone, F.lit(False)))
    merged = Window.partitionBy("node", "look", "alone")
    name = F.when(F.col("seg").rlike("^[*~\\\\]"), F.concat(F.lit("\\"), "seg")).otherwise(F.col("seg"))
    own = own.withColumns({"members": F.count("*").over(merged), "first": F.min(name).over(merged)})
    own = own.select("node", "seg", F.when(F.col("alone") | (F.col("members") == 1), name).otherwise(F.concat(F.lit("~"), "first")).alias("branch"))
    named = common.cut(known.join(own, ["node", "seg"], "left").withColumn("branch", F.when(here, F.coalesce("branch", F.lit("*")))))
    priors = _sums(named.filter("branch is not null"), "node", "above", "branch").groupBy("node").agg(_prior(_rate(), F.first("above")).alias("prior"))
    sizes = named.groupBy("node").agg(F.count("*").alias("size"))
    out = common.spread(named.select("node", "seg", F.col("rows"), "divided", "branch", "above"), common.cut(sizes.join(priors, "node", "left")), ["node"])
    return common.cut(out.select("node", "seg", F.col("rows").alias("size"), "divided", "branch", F.coalesce("prior", "above").alias("prior")))


def templates(urls: DataFrame) -> DataFrame:
    """(host, segs, n, template, purity) of every host and shape of path among ``urls`` (host, path, says)."""
    folded = urls.select("host", _shapes("path").alias("segs"), F.lit(1).alias("n"), F.col("says").isNotNull().cast("int").alias("labelled"), F.coalesce(F.col("says") == "block", F.lit(False)).cast("int").alias("blocked"))
    shapes = common.cut(_sums(folded, "host", "segs"))
    hosts = common.cut(shapes.groupBy("host").agg(F.count("*").alias("size"), *[F.sum(c).alias(c) for c in ("labelled", "blocked")]).withColumns({"top": F.substring_index("host", ".", -1), "n": F.lit(1)}))
    tops = _sums(hosts, "top")
    root = tops.agg(((F.coalesce(F.sum(_rate()), F.lit(0.0)) + 1) / (F.count(_rate()) + 2)).alias("root"))  # one row
    tops = hosts.groupBy("top").agg(F.count("*").alias("size"), F.sum(_rate()).alias("r"), F.count(_rate()).alias("k")).crossJoin(F.broadcast(root))
    tops = common.cut(tops.select("top", "size", ((F.coalesce("r", F.lit(0.0)) + WEIGHT * F.col("root")) / (F.col("k") + WEIGHT)).alias("above")))
    live = common.cut(common.spread(shapes, common.cut(common.spread(hosts.select("host", "top", F.col("size").alias("rows")), tops, ["top"]).select("host", F.col("rows").alias("size"), "above")), ["host"]).withColumn("node", F.col("host")))
    done = []
    out = lambda df, template, prior: df.select("host", "segs", "n", "labelled", "blocked", template.alias("template"), prior.alias("prior"))
    rest = F.concat("node", F.lit("/**"))
    for depth in range(DEEPEST):
        if live.isEmpty():
            break
        keyed = live.withColumn("seg", F.coalesce(F.get("segs", F.lit(depth)), F.lit("")))
        placed = common.cut(common.spread(keyed, _branches(live, depth), ["node", "seg"]))
        ends = F.col("seg") == ""
        done.append(out(placed.filter(~F.col("divided") | ends), F.when(ends, F.col("node")).otherwise(rest), F.when(F.col("divided"), F.col("prior")).otherwise(F.col("above"))))
        live = placed.filter(F.col("divided") & ~ends).select("host", "segs", "n", "labelled", "blocked", F.concat("node", F.lit("/"), "branch").alias("node"), F.col("prior").alias("above"))
    done.append(out(live, F.when(F.size("segs") == DEEPEST, F.col("node")).otherwise(rest), F.col("above")))
    placed = common.cut(reduce(DataFrame.unionByName, done))
    sums = placed.groupBy("template", "prior").agg(F.count("*").alias("size"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    sums = common.cut(sums.select("template", "size", ((F.col("b") + WEIGHT * F.col("prior")) / (F.col("l") + WEIGHT)).alias("purity")))
    return common.spread(placed.select("host", "segs", "n", "template"), sums, ["template"])


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, the rule that wins, the verdict, and the url's template and its purity."""
    common.prepare(pages.sparkSession)
    rule, says = ruled(rules)
    urls = located(pages).withColumns({"rule": rule, "says": says})
    found = common.cut(templates(urls).withColumnRenamed("n", "size"))
    out = common.spread(urls.withColumn("segs", _shapes("path")), found, ["host", "segs"])
    verdict = F.coalesce("says", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "pages"))
