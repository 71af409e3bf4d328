from pyspark.sql import functions as F

from tallyspark.plans import more, views


def test_every_source_counts(spark, sf):
    sources, facts = more._sources(spark, sf).cache(), views.usage(spark, sf)
    history = views.commits(spark, sf).withColumn("shallow", F.lit(False))
    version = lambda s, f, h: more.rollup_version(s, f, h).first()["version"]
    was = version(sources, facts, history)
    last = facts.agg(F.max("origin")).first()[0]
    assert last > 500
    session, agent = facts.filter(F.col("origin") == last).select("session", "agent").first()
    here = (F.col("session") == session) & (F.col("agent") == agent)
    assert version(sources.withColumn("quality", F.when(here, "other").otherwise(F.col("quality"))), facts, history) != was
    assert version(sources, facts.withColumn("at_ms", F.when(F.col("origin") == last, 0).otherwise(F.col("at_ms"))), history) != was
    assert version(sources, facts, history.withColumn("shallow", F.lit(True))) != was
    assert version(sources.repartition(7), facts, history) == was
