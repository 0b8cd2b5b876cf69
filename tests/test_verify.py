import json

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import verify
from corpusforge.plans.merge_run import run_merge
from corpusforge.sources import frontmatter

LONG = "ä" * 3000 + "\n" + "b" * 6000
ATOMS = [("s:1", "s", "one\n"), ("s:2", "s", LONG), ("t:3", "t", ""), ("t:4", "t", "last é")]


def proof(spark, placed, body, **changes):
    layout = verify.slots(spark.createDataFrame(placed, "cluster string, position int, atom_id string"))
    frames = {
        "outputs": spark.createDataFrame([("c", body, {})], "cluster string, body string, fields map<string,string>"), "layout": layout, "atoms": spark.createDataFrame(ATOMS, "id string, skill string, text string"),
        "dropped": spark.createDataFrame([], "id string, reason string"), "router": spark.createDataFrame([], "body string"), "router_slots": spark.createDataFrame([], "role string, template_id string"),
        "routes": spark.createDataFrame([], "position int, label string, skill_name string"),
    } | changes
    return {(r.problem, r.cluster, r.item) for r in verify.verify_all(**frames).collect()}


PLACED = [("c", i, a) for i, (a, _, _) in enumerate(ATOMS, 1)]
BODY = "\n".join(t for _, _, t in ATOMS)


def test_bodies_byte_for_byte(spark):
    assert proof(spark, PLACED, BODY) == set()
    changed = {("body differs from its atoms", "c", "")}
    for body in (BODY + "\n", BODY[:-1], BODY.replace("é", "e"), "", None, BODY[:4000] + "x" + BODY[4001:], "b" + BODY[1:], BODY + "b" * verify.CHUNK):
        assert proof(spark, PLACED, body) == changed, body and body[:10]
    assert proof(spark, [("c", 1, "t:3")], "") == set() and proof(spark, [("c", 1, "t:3")], None) == set()
    assert proof(spark, PLACED[::-1], BODY) == set()  # places count, not the order of rows


def test_starts_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(verify, "BLOCK", 3)
    monkeypatch.setattr(verify, "CHUNK", 5)
    assert proof(spark, PLACED[:1] + PLACED[2:], "one\n\n\nlast é") == set()  # a gap in the places
    assert proof(spark, [(c, i, a) for i, (c, _, a) in enumerate(PLACED[:1] + PLACED[2:], 1)], "one\n\n\nlast é") == set()
    assert proof(spark, PLACED, BODY) == set() and proof(spark, PLACED, BODY.replace("bbb\n", "bb\nb", 1)) != set()


def test_each_other_problem(spark):
    assert proof(spark, PLACED[:1] + [("c", 2, "zz")], "x") == {("unknown atom", "c", "zz")}
    odd = verify.slots(spark.createDataFrame(PLACED, "cluster string, position int, atom_id string")).withColumn("template_id", F.when(F.col("position") == 1, "glue").otherwise(F.col("template_id")))
    assert proof(spark, PLACED, BODY, layout=odd) == {("unknown scaffold", "c", "glue")}
    assert proof(spark, PLACED + [("c", 5, "s:1")], BODY + "\none\n") == {("atom in more than one place", None, "s:1")}
    dropped = spark.createDataFrame([("a", None), ("b", ""), ("c", "out-of-scope")], "id string, reason string")
    assert proof(spark, PLACED, BODY, dropped=dropped) == {("dropped without a reason", None, "a"), ("dropped without a reason", None, "b")}
    fields = spark.createDataFrame([("c", BODY, {"allowed-tools": "Read", "compatibility": "py3", "name": "own", "metadata": "{}"})], "cluster string, body string, fields map<string,string>")
    expected = spark.createDataFrame([("c", "allowed-tools", "Edit"), ("c", "metadata", "{}"), ("c", "disallowed-tools", "Web")], "cluster string, field string, value string")
    assert proof(spark, PLACED, BODY, outputs=fields, expected=expected) == {("frontmatter differs from its sources", "c", "allowed-tools"), ("frontmatter without a source", "c", "compatibility")}


def test_router(spark):
    two = spark.createDataFrame([("c", BODY, {}), ("d", "one\n", {})], "cluster string, body string, fields map<string,string>")
    routes = spark.createDataFrame([(2, "d", "d-name"), (1, "c", "c-name")], "position int, label string, skill_name string")
    body = "# Orchestrator\n\nRoute each request to the matching skill.\n\n- When the task involves c, use the c-name skill.\n- When the task involves d, use the d-name skill.\n"
    slots = spark.createDataFrame([("scaffold", "orch-intro"), ("scaffold", "route"), ("scaffold", "sep")], "role string, template_id string")
    judged = lambda outputs, text, s: {(r.problem, r.item) for r in verify.router_problems(outputs, spark.createDataFrame([(t,) for t in text], "body string"), s, routes).collect()}
    assert judged(two, [body], slots.limit(2)) == set() and judged(two, [], slots.limit(0)) == {("router missing", "")}
    assert judged(two, [body + " "], slots) == {("router differs from its routes", ""), ("unknown scaffold", "sep")}
    assert judged(two.limit(1), [body], slots.limit(2)) == {("router for one output", "")}


def test_frontmatter_is_carried_and_proven(spark):
    heads = {
        "a": "allowed-tools: Read, Bash(git add *) Edit\ndisallowed-tools: Web\ncompatibility: py3\nmetadata:\n  owner: x\n  n: 1\n",
        "b": "allowed-tools:\n  - Read\n  - Bash(git add *)\n  - ' '\ncompatibility: node\ndisable-model-invocation: TRUE\nmetadata:\n  owner: y\n", "c": "name: c\nallowed-tools:\ndisallowed-tools: Write Web\ncompatibility: py3\n", "d": "",
    }
    docs = spark.createDataFrame([(k, f"---\n{v}---\nAlways keep tests of {k} small.\n") for k, v in heads.items()], "skill string, text string")
    docs = frontmatter.split_frontmatter(docs).select("skill", "body", "frontmatter")
    run = run_merge(docs, [], limit=1)
    assert run.problems.collect() == []
    fields = run.outputs.first().fields
    assert fields == {"allowed-tools": "Bash(git add *) Read", "disallowed-tools": "Web Write", "disable-model-invocation": "true", "compatibility": "py3; node", "metadata": json.dumps({"n": "1", "owner": "x"}, separators=(",", ":"))}
    found = {(r.rule_id, r.severity, r.message) for r in run.findings.collect()}
    assert found == {
        ("merge:allowed-tools-narrowed", "medium", "not allowed by every source: Edit"), ("merge:disallowed-tools-joined", None, "disallowed by any source: Web Write"), ("merge:invocation-disabled", "medium", "disabled by: b"),
        ("merge:compatibility-joined", None, "from more than one source"), ("merge:metadata-differs", None, "kept the first source's owner"),
    }


def test_tools_that_no_token_fits_allow_nothing(spark):
    told = frontmatter.declared(spark.createDataFrame([(json.dumps({"allowed-tools": x}),) for x in ("***", "", [], ["A b", 3], "[X, Y]", None, True)] + [("nonsense",), (None,)], "frontmatter string")).select("allowed").collect()
    assert [r.allowed for r in told] == [[], None, None, ["A b", "3"], ["X", "Y"], None, ["true"], None, None]


@pytest.mark.parametrize("text", ["---\n---\nx", "---\n\n---\nx", "---\na: b\n--- \nx", "---\na: b\n---", "x\n---\na: b\n---\n", "---\na: ü\n---\nbody\n---\nmore", ""])
def test_heads_are_cut_as_the_parser_does(spark, text):
    row = frontmatter.split_frontmatter(spark.createDataFrame([(text,)], "text string")).first()
    assert (json.loads(row.frontmatter), row.body) == frontmatter.parse(text)
