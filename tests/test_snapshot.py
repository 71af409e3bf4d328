import json

import pytest

from tallyspark.functions import clock
from tallyspark.operators import usage
from tallyspark.plans import catalog, snapshot, views
from tallyspark.sources import git


def test_snapshot(spark, sf, tmp_path):
    slots = catalog._hourly(spark, sf)
    assert snapshot.violations(slots).count() == 0
    assert snapshot.violations(slots.withColumn("active_ms", slots.active_ms + 1)).count() > 0
    spine = catalog._text(clock.spine(spark, views.CUTOFF_MS, views.ZONE, 365), "date")
    doc = snapshot.days(spine, catalog.a2_usage_daily(spark, sf), slots, catalog.a7_usage_by_model(spark, sf))
    snapshot.export(doc, str(tmp_path), ["/home/secret"])
    days = json.load((tmp_path / "activity.json").open())["days"]
    assert len(days) == 365 and len(days[338]["hours"]) == 24 and days[338]["usage"]["records"] == sum(r["records"] for r in days[338]["usage_rows"])
    with pytest.raises(ValueError):
        snapshot.export(doc, str(tmp_path / "b"), ["gpt-5.6-sol"])


def test_git_lines(spark):
    rows, bad = git.parsed("r", f"{'a' * 40}\t12\nbroken\n{'b' * 39}\t1\n", False)
    assert rows == [("r", "a" * 40, 12_000, False)] and bad == 2


def test_git_commits(spark, tmp_path):
    import os

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(f"{here}/.git"):
        found = git.scanned(spark, [here, str(tmp_path)])
        told = {r.repository: r.problem for r in git.problems(found).collect()}
        assert told[str(tmp_path)] == "unreadable" and told[here] in (None, "missing-ref")
        assert (git.commits(found).count() > 0) == (told[here] is None)


def test_snapshot_raises_instead_of_dropping_days(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "DAYS", 3)
    with pytest.raises(ValueError):
        snapshot.export(spark.range(4).selectExpr("cast(id as string) as date"), str(tmp_path), [])
