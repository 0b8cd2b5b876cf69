import hashlib
import json

import pytest

from corpusforge.operators.evaluate import edit_description
from corpusforge.sources.catalog import FetchError, fetch_bundle
from corpusforge.sources.ledger import InterchangeError, load_ledger, with_decision, write_ledger


def entry(files):
    listed = [{"path": p, "sha256": hashlib.sha256(d).hexdigest()} for p, d in files.items()]
    lines = "\n".join(f"{f['path']}\0{f['sha256']}" for f in sorted(listed, key=lambda f: f["path"]))
    return {"id": "x", "files": listed, "fetch_base": "base/", "bundle_hash": hashlib.sha256(lines.encode()).hexdigest()}


def test_bundles_are_fetched_whole_or_not_at_all(tmp_path):
    files = {"SKILL.md": b"one", "scripts/a.py": b"two"}
    asked = []

    def fetch(address):
        asked.append(address)
        return files[address.removeprefix("base/")]

    place = fetch_bundle(entry(files), fetch, str(tmp_path))
    assert sorted(asked) == ["base/SKILL.md", "base/scripts/a.py"]
    assert fetch_bundle(entry(files), fetch, str(tmp_path)) == place and len(asked) == 2
    (tmp_path / "bundles" / entry(files)["bundle_hash"] / "SKILL.md").write_bytes(b"changed")
    assert fetch_bundle(entry(files), fetch, str(tmp_path)) == place and len(asked) == 4
    other = {"SKILL.md": b"one", "b.md": b"three"}
    for bad in (entry({}), entry(files) | {"fetch_base": ""}, entry(files) | {"bundle_hash": "0"}, entry({"../x": b"x"}), entry(other)):
        with pytest.raises(FetchError):
            fetch_bundle(bad, lambda address: b"other bytes", str(tmp_path))
    assert [p.name for p in (tmp_path / "bundles").iterdir()] == [entry(files)["bundle_hash"]]


def test_ledger(tmp_path):
    path = str(tmp_path / "history.json")
    assert load_ledger(path) is None
    ledger = None
    for before, after, accepted in ((0.5, 0.6, True), (0.6, 0.4, False), (0.6, 0.6, True)):
        ledger = with_decision(ledger, "a", {"before": before, "after": after, "accepted": accepted}, "t0")
    write_ledger(ledger, path)
    assert load_ledger(path) == ledger and ledger["current_best"] == "v3" and ledger["started_at"] == "t0"
    assert [(v["version"], v["parent"], v["grading_result"], v["is_current_best"]) for v in ledger["iterations"]] == [("v0", None, "baseline", False), ("v1", "v0", "won", False), ("v2", "v1", "lost", False), ("v3", "v1", "won", True)]
    with pytest.raises(InterchangeError):
        with_decision(ledger, "b", {"before": 0, "after": 1, "accepted": True}, "t1")
    for text in ("{", json.dumps({"skill_name": "a"}), json.dumps(ledger | {"current_best": "v9"})):
        (tmp_path / "history.json").write_text(text)
        with pytest.raises(InterchangeError):
            load_ledger(path)


def test_edits_are_gated(spark):
    surfaces = spark.createDataFrame([("alpha", "format tables of numbers"), ("beta", "review pull requests")], "name string, description string")
    queries = spark.createDataFrame([(f"q{i}", t, "trigger", s, "host") for i, (t, s) in enumerate([("format these tables", "alpha"), ("review my pull", "beta"), ("numbers in tables", "alpha"), ("review requests", "beta")])], "query_id string, text string, kind string, expected_skill string, origin string")
    right = queries.selectExpr("query_id", "expected_skill AS routed_skill", "0 AS position")
    wrong = queries.selectExpr("query_id", "'beta' AS routed_skill", "0 AS position")
    out, decision = edit_description(surfaces, "alpha", "format tables of numbers and dates", queries, right, right)
    assert decision["accepted"] and out.filter("name = 'alpha'").first()["description"].endswith("dates")
    out, decision = edit_description(surfaces, "alpha", "format tables of numbers and dates", queries, right, wrong)
    assert not decision["accepted"] and out.filter("name = 'alpha'").first()["description"] == "format tables of numbers"
    out, decision = edit_description(surfaces, "alpha", "nothing of the kind", queries, right, right)
    assert not decision["accepted"] and decision["after_independent"] < decision["before_independent"]
    assert not edit_description(surfaces, "gamma", "x", queries, right, right)[1]["accepted"]


def test_edits_of_the_router_and_of_bodies(spark):
    outputs = spark.createDataFrame([("alpha", "format tables of numbers", "Use tables."), ("beta", "review pull requests", "Review all.")], "name string, description string, body string")
    router = spark.createDataFrame([("Routes requests", "# Orchestrator\n")], "description string, body string")
    queries = spark.createDataFrame([(f"q{i}", t, "trigger", s, "host") for i, (t, s) in enumerate([("format these tables", "alpha"), ("review my pull", "beta")])], "query_id string, text string, kind string, expected_skill string, origin string")
    right = queries.selectExpr("query_id", "expected_skill AS routed_skill", "0 AS position")
    out, decision = edit_description(outputs, "orchestrator", "Routes all requests", queries, right, right, router=router)
    assert decision["accepted"] and {r["name"]: r["description"] for r in out.collect()}["orchestrator"] == "Routes all requests"
    assert not edit_description(outputs, "orchestrator", "x", queries, right, right)[1]["accepted"]
    assert edit_description(outputs, "orchestrator", " ", queries, right, right, router=router)[1]["reasons"] == ["new quality issues"]
    assert edit_description(outputs, "beta", "review pull requests; format these tables", queries, right, right)[1]["reasons"][:1] == ["leaks"]
    across = edit_description(outputs, "alpha", "format", queries, right, right, edited=outputs.selectExpr("name", "description", "replace(body, 'all', 'most') AS body"))[1]
    assert across["reasons"] == ["bodies differ"]


def test_a_bundle_stays_when_the_new_one_cannot_take_its_place(tmp_path, monkeypatch):
    files = {"SKILL.md": b"one"}
    place = fetch_bundle(entry(files), lambda a: b"one", str(tmp_path))
    (tmp_path / "bundles" / entry(files)["bundle_hash"] / "extra").write_bytes(b"x")
    import pathlib

    rename = pathlib.Path.rename
    monkeypatch.setattr(pathlib.Path, "rename", lambda self, to: (_ for _ in ()).throw(OSError("busy")) if self.name == "whole" else rename(self, to))
    with pytest.raises(OSError):
        fetch_bundle(entry(files), lambda a: b"one", str(tmp_path))
    assert (pathlib.Path(place) / "SKILL.md").read_bytes() == b"one"


def test_tables_are_cleared(spark, tmp_path):
    from corpusforge.sources import tables

    table = tables.saved(spark.range(3).toDF("n"), "x")
    path = table.inputFiles()[0].removeprefix("file:")
    assert spark.sparkContext.applicationId in path
