"""The public document: whole, strict, consistent."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import catalog, document, snapshot, stateful


@pytest.fixture(scope="module")
def written(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("doc"))
    return json.load(open(document.export(stateful.public_document(spark, sf), folder, ["/home/secret"]), encoding="utf-8"))


def test_the_document_is_whole(written):
    assert list(written) == ["schemaVersion", "pricing", "organization", "timezone", "generatedAt", "cutoff", "periodStart", "periodEnd", "collectionStatus", "sources", "coverage", "inputRanges", "days"]
    assert len(written["days"]) == 365 and written["periodEnd"] == "2024-01-30" and {len(d["hours"]) for d in written["days"]} == {18 - 5, 23, 24, 25}
    day = written["days"][-5]
    assert sum(r["usage"]["total"]["value"] or 0 for r in day["usageRows"]) == day["usage"]["total"]["value"] > 0
    assert sum(h["work"]["work"]["value"]["activeMs"] for h in day["hours"]) == day["work"]["work"]["value"]["activeMs"] > 0
    assert sum(b["elapsedMs"] for b in day["work"]["work"]["value"]["histogram"]) == day["elapsedMs"] == 86_400_000
    assert [h["harness"] for h in day["work"]["byHarness"]] == list(document.AGENTS)


def broken(spark, text):
    rows = document.parsed(spark.createDataFrame([(text,)], "text string"))
    got = rows.filter("document is not null").select("document.*")
    return None if got.isEmpty() else {r.rule for r in document.violations(got).collect()}


def test_strict_load(spark, written, tmp_path):
    small = json.dumps(written | {"days": written["days"][-2:]})
    assert broken(spark, small) == set()
    change = lambda f: (lambda d: (f(d), json.dumps(d))[1])(json.loads(small))
    shape = [
        lambda d: d.update(more=1), lambda d: d.pop("timezone"), lambda d: d.update(schemaVersion=5), lambda d: d.update(schemaVersion="6"), lambda d: d["days"][0].update(x=None), lambda d: d["days"][0]["usage"].pop("total"),
        lambda d: d["days"][0]["usage"]["total"].update(value="5"), lambda d: d["days"][0]["hours"][0]["work"]["work"].pop("reasons"), lambda d: d["inputRanges"].pop("7"), lambda d: d["inputRanges"].update({"8": None}), lambda d: d["pricing"].update(sources="x"),
    ]
    texts = [(t,) for t in (*map(change, shape), small[:-1], "NaN", "[]")]
    assert document.parsed(spark.createDataFrame(texts, "text string")).filter("document is not null").count() == 0
    day = lambda d: d["days"][-1]
    work = lambda d: next(h["work"]["work"]["value"] for h in day(d)["hours"] if h["work"]["work"]["value"])
    rules = {
        "organization": lambda d: d.update(organization=" x"), "instants": lambda d: d.update(cutoff="yesterday"), "period": lambda d: d.update(periodStart="2024-13-01"), "collection": lambda d: d.update(collectionStatus="fine"), "pricing": lambda d: d["pricing"].update(sources=["http://x"]),
        "sources": lambda d: d["sources"][0].update(state="gone"), "coverage": lambda d: d["coverage"].update(unallocatedUsageRecords=-1), "counts": lambda d: day(d)["usage"]["total"].update(value=-5), "status": lambda d: day(d)["commits"].update(status="ok"),
        "reasons": lambda d: day(d)["commits"].update(reasons=["parse-gap", "missing-source"]), "label": lambda d: day(d)["usageRows"][0].update(model="sk-secret"), "inference-in-active": lambda d: work(d).update(inferenceMs=work(d)["activeMs"] + 1),
        "histogram": lambda d: work(d)["histogram"].append({"agents": 0, "elapsedMs": 5}), "harness-order": lambda d: day(d)["work"]["byHarness"].reverse(), "scope": lambda d: day(d)["scope"]["byHarness"][0]["included"].update(unknownTotalRecords=10**9),
        "harness-sums": lambda d: d["inputRanges"]["7"]["all"]["excluded"].update(context=10**6), "considered": lambda d: d["inputRanges"]["30"]["all"]["cadenceCoverage"].update(consideredSessions=1), "availability": lambda d: d["inputRanges"]["90"]["all"]["inputs"].update(status="unavailable"),
    }
    assert broken(spark, change(lambda d: [f(d) for f in rules.values()])) == set(rules)
    path = tmp_path / "bad.json"
    path.write_text(change(rules["label"]))
    with pytest.raises(ValueError, match="label"):
        document.load(spark, str(path))
    path.write_text("{}")
    with pytest.raises(ValueError, match="not a public document"):
        document.load(spark, str(path))


def test_private_strings_stop_the_export(spark, sf, written, tmp_path):
    rows = document.parsed(spark.createDataFrame([(json.dumps(written | {"days": written["days"][-1:]}),)], "text string")).select("document.*")
    with pytest.raises(ValueError, match="private"):
        document.export(rows, str(tmp_path), ["house"])
    assert not (tmp_path / "activity.json").exists()


def test_slots_with_idle_time_break_no_rule(spark, sf):
    slots = catalog.i5_slot_stats(spark, sf)
    assert snapshot.violations(slots).count() == 0 and slots.filter(F.startswith("histogram", F.lit("0:"))).count() > 0
