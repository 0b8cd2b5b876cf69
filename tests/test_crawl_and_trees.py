import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import PurePosixPath

import pytest

from corpusforge.operators import code_rules, scan, spdx
from corpusforge.sources import crawl, emit, repository, tree_sink

TREE = {"LICENSE": b"Permission is hereby granted, free of charge", "SKILL.md": b"---\nname: top\ntags: a, [b\nlanguages:\n  - x y\n---\nbody", "other/x.txt": b"x", "k/SKILL.md": b"no front", "k/gone.txt": None, "m/SKILL.md": b"", "n/SKILL.md": b"n"}


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            path, _, query = self.path.partition("?")
            body = None
            if path == "/api/repos/o/r":
                body = json.dumps({"default_branch": "dev"}).encode()
            elif path == "/api/repos/o/r/commits/dev":
                body = json.dumps({"sha": "c0"}).encode()
            elif path == "/api/repos/o/r/git/trees/c0" and query == "recursive=1":
                body = json.dumps({"tree": [{"path": p, "type": "blob"} for p in TREE] + [{"path": "k", "type": "tree"}]}).encode()
            elif path.startswith("/raw/o/r/c0/"):
                body = TREE.get(path[12:])
            self.send_response(404 if body is None else 200)
            self.send_header("Content-Length", str(len(body or b"")))
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_crawl(spark, server):
    files = crawl.read_trees(spark, ["o/r", "o/none"], f"{server}/api", f"{server}/raw")
    got = {r.path: r.content if r.content is None else bytes(r.content) for r in files.collect()}
    assert got == TREE and {r.ref for r in files.select("ref").distinct().collect()} == {"c0"}
    entries = {r.id: r for r in crawl.build_entries(files, f"{server}/raw").collect()}
    assert set(entries) == {"o/r", "o/r:n"}  # k lacks a file, m's text is empty
    top = entries["o/r"]
    assert (top.name, top.spdx_id, top.tags, top.languages, top.fetch_base) == ("top", "MIT", ["a", "[b"], ["x y"], f"{server}/raw/o/r/c0")
    assert [f.path for f in top.files] == ["LICENSE", "SKILL.md", "other/x.txt"] and entries["o/r:n"].name == "n"


def test_tree_is_written_whole_or_not_at_all(spark, tmp_path):
    rows = [(f"d{i % 7}/f{i}.txt", bytes([i % 256]) * i) for i in range(200)] + [("é/ü", None)]
    files = spark.createDataFrame(rows, "path string, content binary").repartition(5)
    out = tmp_path / "out"
    tree_sink.write_files(files, f"file://{out}")
    assert {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file()} == {p: c or b"" for p, c in rows}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    read = {r.path: bytes(r.content) for r in repository.read_files(spark, f"file://{out}").collect()}
    assert read == {p: c or b"" for p, c in rows}
    for bad in ("../x", "", "a//b", "/a", None):
        broken = files.union(spark.createDataFrame([(bad, b"x"), ("late", b"y")], files.schema).coalesce(1))
        with pytest.raises(Exception, match="path|NoneType"):
            tree_sink.write_files(broken, f"file://{tmp_path}/bad")
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_outputs_with_support_files(spark, tmp_path):
    docs = spark.createDataFrame([("x", "about x", None, None, None, None, False, {}, "see scripts/a.sh and assets/none.png")], "name string, description string, license string, compatibility string, allowed_tools string, disallowed_tools string, disable_model_invocation boolean, metadata map<string,string>, body string")
    bundles = spark.createDataFrame([("x", "scripts/a.sh", b"echo"), ("x", "scripts/b.sh", b"unused"), ("y", "scripts/a.sh", b"other")], "name string, path string, content binary")
    assert emit.write_tree(docs, str(tmp_path / "o"), "# P\n", "set", bundles) == ["PROVENANCE-set.md", "x/SKILL.md", "x/scripts/a.sh"]
    assert (tmp_path / "o/x/scripts/a.sh").read_bytes() == b"echo" and emit.default_plugin_name(docs) == "x"


def test_walk_order_is_that_of_paths(spark):
    rng = random.Random(1)
    names = ["a", "a-b", "a.b", "a b", "A", "é", "a!", "~", "0", "ab", "😀"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(300)}) + ["x/build/y", "dist", "a/.git/z"]
    got = scan.bundle_walk(spark.createDataFrame([("b", p) for p in paths], "bundle_id string, path string"), "/r").orderBy("position").collect()
    assert [r.path for r in got] == [str(p) for p in sorted(PurePosixPath(p) for p in paths[:-3])]
    assert scan.bundle_walk(spark.createDataFrame([("b", "a")], "bundle_id string, path string"), "/home/target/r").count() == 0


def test_calls_in_python():
    calls = lambda text: code_rules.python_calls(text)
    assert calls("from os import *\nimport os.path\nos.system('x')") == [("python-os-system", 3)]
    assert calls("import builtins\nbuiltins.eval(x)\nx.eval(y)\n'eval(z)'") == [("python-eval", 2)]
    assert calls("import subprocess as s\ns.Popen(a,\n shell=True)\ns.run(a, shell=x)\nfrom subprocess import call\ncall(z, shell=True)") == [("python-subprocess-shell", 2), ("python-subprocess-shell", 6)]
    assert calls("from yaml import load, SafeLoader\nload(f, Loader=SafeLoader)\nload(f, Loader=Other)") == [("python-yaml-unsafe-load", 3)]
    assert calls("def f(:") == calls("x\0y") == calls("") == [] and calls("(" * 5000) == []


def test_calls_in_scripts():
    calls = lambda text: code_rules.js_calls(text)
    assert calls("`${x} eval(a)`; eval (b)\n'eval(c)' /* eval(d)\n*/ eval\n(e)") == [("js-eval", 1), ("js-eval", 3)]
    assert calls("function eval(x) {}\nw.eval(y)\n'it\\'s eval(z)'") == []
    assert calls("child_process.exec(x)\nfoo.exec(y)\nlet p = require(\"child_process\")\np.execSync(z); q.p.exec(w)") == [("js-child-process", 1), ("js-child-process", 4)]
    assert calls("'unclosed eval(x)\neval(y)") == [("js-eval", 2)] and calls("") == []


def test_expressions(spark):
    cases = {
        "MIT": (True, "MIT", 1, "MIT", False), " mit  oR apache-2.0 ": (True, "MIT", 1, "Apache-2.0", False), "(MIT OR GPL-3.0-only) AND Apache-2.0": (True, "Apache-2.0", 3, "GPL-3.0-only", False),
        "MIT OR GPL-3.0-only AND Apache-2.0": (True, "MIT", 1, "GPL-3.0-only", False), "GPL-2.0-only WITH Classpath-exception-2.0 and MIT": (True, "GPL-2.0-only WITH Classpath-exception-2.0", 6, "GPL-2.0-only", True),
        "MPL-1.1+ OR ((GPL-3.0-only))": (True, "GPL-3.0-only", 7, "MPL-1.1", True), "ISC AND MIT": (True, "ISC", 1, "ISC", False), "ISC OR MIT": (True, "ISC", 1, "ISC", False),
    }
    bad = ["(MIT", "MIT)", "MIT MIT", "AND MIT", "MIT AND", "()", "", " ", None, "GPL-2.0-only+", "MIT WITH MIT", "LLVM-exception", "MIT WITH LLVM-exception WITH LLVM-exception", "(MIT OR ISC) WITH LLVM-exception", "Odd OR MIT", "MIT OR OR ISC", ")(", "MIT AND LLVM-exception"]
    df = spark.createDataFrame([(e,) for e in [*cases, *bad]], "e string").select("e", spdx.evaluate("e").alias("v"))
    assert {r.e: tuple(r.v) for r in df.collect()} == cases | {e: (False, None, None, None, False) for e in bad}
    assert spark.range(1).select(spdx.postfix(spdx.F.lit("a OR b AND (c WITH d OR e)")).alias("p")).first().p == ["a", "b", "c", "d", "with", "e", "or", "and", "or"]


def test_index_keeps_the_first_record(spark):
    files = spark.createDataFrame([("a", "x.md", b"hello"), ("b", "x.md", b"hello"), ("c", "y.sh", b"rm -rf / ")], "bundle_id string, path string, content binary")
    index = spark.createDataFrame([(1, "gone", "1", "r", "pass", "t0"), (0, "gone", "2", "r", "block", "t1")], "position int, bundle_hash string, scanner_version string, ruleset_version string, verdict string, scanned_at string")
    merged, made = scan.update_index(index, files, "2", "r", "now")
    assert sorted(r.verdict for r in made.collect()) == ["block", "pass"]  # a and b are one
    assert {(r.bundle_hash == "gone", r.verdict, r.scanned_at) for r in merged.collect()} == {(True, "block", "t1"), (False, "pass", "now"), (False, "block", "now")}
    again, none = scan.update_index(merged.selectExpr("0 as position", "*"), files, "2", "r", "later")
    assert none.count() == 0 and sorted(again.collect()) == sorted(merged.select(again.columns).collect())
