import hashlib

import pytest

from corpusforge.operators import merge
from corpusforge.plans.merge_run import run_merge
from corpusforge.sources.markdown import atoms_of, parse_atoms

SAMPLE = """# Title

Always validate the schema first. Then go on.

- item one
  - nested item
- item two

When the user asks for a report, build it.

> quoted text
goes on

```python
x = 1

y = 2
```

Setext
======

1. first
2. second

<div>
html
</div>

---

    indented code
"""


def test_atoms_are_slices():
    raw = SAMPLE.encode()
    atoms = atoms_of(SAMPLE)
    assert all(raw[a:b].decode() == t for _, _, a, b, t in atoms)
    assert [(block, path) for block, path, *_ in atoms] == [
        ("heading", "h0"), ("paragraph", "p1"), ("paragraph", "l2/i0/p0"), ("paragraph", "l2/i0/l1/i0/p0"), ("paragraph", "l2/i1/p0"), ("paragraph", "p3"), ("paragraph", "q4/p0"),
        ("fence", "c5"), ("heading", "h6"), ("paragraph", "l7/i0/p0"), ("paragraph", "l7/i1/p0"), ("html_block", "x8"), ("hr", "r9"), ("code_block", "c10"),
    ]


def test_fence_with_a_blank_line_and_plain_paragraph():
    fence = "```python\nx = 1\n\ny = 2\n```\n"
    assert [t for *_, t in atoms_of(fence)] == [fence]
    text = "Validate the input. Then call the API. Return the result.\n"
    assert [t for *_, t in atoms_of(text)] == [text]
    assert atoms_of("") == [] and atoms_of("é\n\nü")[1][2:4] == (4, 6)


def test_parsed_table(spark):
    docs = spark.createDataFrame([("s", SAMPLE), ("t", "Same line here.\n\n## B\n\nSame line here.\n"), ("n", None)], "skill string, body string")
    rows = parse_atoms(docs).collect()
    first = next(r for r in rows if r.skill == "s" and r.path == "p1")
    assert first.id == "s:p1:" + hashlib.sha256(first.text.encode()).hexdigest()[:16] and first.detected_kind == "directive"
    kinds = {r.path: r.detected_kind for r in rows if r.skill == "s"}
    assert kinds["h0"] == "heading" and kinds["p3"] == "trigger" and kinds["c5"] == "example" and kinds["q4/p0"] == "context"
    same = [r for r in rows if r.skill == "t" and r.text.startswith("Same")]
    assert len(same) == 2 and same[0].id != same[1].id and same[0].norm_key == same[1].norm_key
    assert not [r for r in rows if r.skill == "n"]


def test_grouping(spark):
    atoms = spark.createDataFrame([("x", "directive"), ("y", "context")], "id string, detected_kind string")
    given = spark.createDataFrame([("x", "g", "context"), ("y", "g", "example")], "atom_id string, `group` string, kind string")
    rows = {r.atom_id: (r.kind, r.forced) for r in merge.validate_grouping(atoms, given).collect()}
    assert rows == {"x": ("directive", True), "y": ("example", False)}
    for bad in (given.filter("atom_id = 'x'"), given.union(spark.createDataFrame([("z", "g", "context")], given.schema))):
        with pytest.raises(merge.GroupingError):
            merge.validate_grouping(atoms, bad)


def test_foreign_winner(spark):
    conflicts = spark.createDataFrame([("a", "b", "numeric-bound", "structural")], "atom_a string, atom_b string, type string, source string")
    ruling = spark.createDataFrame([(0, "a", "b", None, None, "c")], "position int, atom_a string, atom_b string, type string, severity string, winner string")
    with pytest.raises(merge.ConflictError):
        merge.adjudicate(conflicts, ruling)


def closure_tables(spark, edges):
    atoms = spark.createDataFrame([("a", "tabs rule"), ("b", "other"), ("c", "third"), ("d", "far")], "id string, text string")
    rows = [(x, y, y, "atom") for x, y in edges]
    return atoms, spark.createDataFrame(rows, "src_atom_id string, target_ref string, resolved_atom_id string, kind string")


def test_closure(spark):
    none = spark.createDataFrame([], "id string")
    atoms, edges = closure_tables(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    got = {r.id: (r.status, r.reason) for r in merge.prune_and_close(atoms, ["tabs"], edges, none).collect()}
    assert got == {"a": ("kept", None), "b": ("kept", None), "c": ("kept", None), "d": ("dropped", "out-of-scope")}
    with pytest.raises(merge.PruneError):
        merge.prune_and_close(atoms, ["tabs"], edges, spark.createDataFrame([("c",)], "id string"))
    everything = merge.prune_and_close(atoms, [], edges, spark.createDataFrame([("d",)], "id string"))
    assert {r.id: r.reason for r in everything.collect() if r.status == "dropped"} == {"d": "conflict-loser"}


def test_partition_stops_at_conflicts(spark):
    groups = spark.createDataFrame([(f"a{i}", f"g{i}") for i in range(4)], "atom_id string, `group` string")
    kept = groups.selectExpr("atom_id as id")
    clash = spark.createDataFrame([(f"a{i}", f"a{j}") for i in range(4) for j in range(i + 1, 4)], "atom_a string, atom_b string")
    clusters, warnings = merge.partition(kept, groups, clash)
    assert clusters.select("cluster").distinct().count() == 4 and len(warnings) == 1


def test_edges_keep_the_folder_only(spark):
    atoms = spark.createDataFrame([("a", None, "dependency-ref", "see references/x.md and notes.md"), ("b", None, "context", "scripts/run.sh")], "id string, kind string, detected_kind string, text string")
    assert [(r.src_atom_id, r.target_ref) for r in merge.build_edges(atoms).collect()] == [("a", "references")]


DOCS = [("alpha", "# A\n\nAlways use tabs for indentation.\n\nShared line.\n"), ("beta", "Never use tabs for indentation at all, ever.\n\nShared line.\n")]


def test_whole_merge(spark):
    run = run_merge(spark.createDataFrame(DOCS, "skill string, body string"), [])
    assert run.problems.count() == 0 and run.warnings == []
    bodies = {r.cluster: r.body for r in run.outputs.collect()}
    assert set(bodies) == {"alpha", "beta"} and "Never use tabs" in bodies["beta"] and "Always" not in bodies["alpha"]
    assert sum("Shared line." in b for b in bodies.values()) == 1
    assert run.router.first().body.startswith("# Orchestrator\n\nRoute") and [r.reason for r in run.dropped.collect()] == ["conflict-loser"]


def test_tampering_is_found(spark):
    from pyspark.sql import functions as F

    run = run_merge(spark.createDataFrame(DOCS, "skill string, body string"), [])
    place = run.layout.select("cluster", "position", "atom_id")
    changed = merge.verify(run.outputs.withColumn("body", F.concat("body", F.lit("!"))), place, run.atoms, run.dropped)
    assert {r.problem for r in changed.collect()} == {"body differs from its atoms"}
    foreign = place.withColumn("atom_id", F.when(F.col("position") == 1, "zz").otherwise(F.col("atom_id")))
    assert "unknown atom" in {r.problem for r in merge.verify(run.outputs, foreign, run.atoms, run.dropped).collect()}
    twice = merge.verify(run.outputs, place.union(place.limit(1)), run.atoms, run.dropped)
    assert "atom in more than one place" in {r.problem for r in twice.collect()}
