"""Queries of sources, sinks and their checks whose rows come from documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import rules as R
from corpusforge.operators import code_rules, license_ids, merge, scan, spdx
from corpusforge.plans.queries import _KIND, _LINES_BY_DOC, _WHOLE, _doc_files
from corpusforge.plans.registry import query, read, sql_list
from corpusforge.sources import catalog, crawl, emit, markdown, repository


def _of(values, n, shift=0):
    """One of values by the number n."""
    return F.element_at(F.array(*map(F.lit, values)), ((n + shift) % len(values) + 1).cast("int"))


def _sql_of(values, n="doc_id", shift=0):
    return f"[{sql_list(values)}][({n} + {shift}) % {len(values)} + 1]"


# --- license expressions: each document's first line states one

_IDS = ["MIT", "Apache-2.0", "GPL-2.0-only", "ISC", "AGPL-3.0-only", "MPL-2.0", "Unlicense"]
_SHAPES = ["{a}", "{a} OR {b}", "{a} AND {b}", "({a} or {b}) AND {c}", "{a} OR {b} AND {c}", "{a} WITH Classpath-exception-2.0", "({a}", "{a} {b}", "MPL-1.1+ and {b}", "{a} AND (", "{a} OR Weird-1.0", "(({a} AND {b}) WITH LLVM-exception)", "{b} OR ({a} with LLVM-exception)"]
_TERM = lambda shift: f"{{'id': {_sql_of(_IDS, shift=shift)}, 'r': {{rank}}[{_sql_of(_IDS, shift=shift)}], 'base': {_sql_of(_IDS, shift=shift)}}}"
_RANKS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in {**license_ids.RESTRICTIVENESS, "MPL-1.1": 9}.items()) + "}"


def _sql_expressions() -> str:
    a, b, c = (_TERM(s).replace("{rank}", _RANKS) for s in (0, 1, 3))
    both = lambda x, y: f"(CASE WHEN ({x}).r > ({y}).r OR (({x}).r = ({y}).r AND ({x}).id <= ({y}).id) THEN {x} ELSE {y} END)"
    either = lambda x, y: f"(CASE WHEN ({x}).r < ({y}).r OR (({x}).r = ({y}).r AND ({x}).id <= ({y}).id) THEN {x} ELSE {y} END)"
    later = "{'id': 'MPL-1.1+', 'r': 9, 'base': 'MPL-1.1'}"
    with_ = lambda t, e: f"{{'id': ({t}).id || ' WITH {e}', 'r': ({t}).r, 'base': ({t}).base}}"
    chosen = {0: "a", 1: either("a", "b"), 2: both("a", "b"), 3: both(either("a", "b"), "c"), 4: either("a", both("b", "c")), 5: with_("a", "Classpath-exception-2.0"), 8: both(later, "b"), 12: either("b", with_("a", "LLVM-exception"))}
    terms = {0: "[a]", 1: "[a, b]", 2: "[a, b]", 3: "[a, b, c]", 4: "[a, b, c]", 5: "[a]", 8: f"[{later}, b]", 12: "[a, b]"}
    k = f"doc_id % {len(_SHAPES)}"
    case = lambda of: "CASE " + " ".join(f"WHEN {k} = {i} THEN {of(i)}" for i in chosen) + " END"
    strict = lambda i: f"(list_sort(list_transform({terms[i]}, lambda x: {{'r': -x.r, 'base': x.base}}))[1]).base"
    return f"""WITH t AS (SELECT doc_id, {a} AS a, {b} AS b, {c} AS c FROM documents), x AS (SELECT doc_id, {case(lambda i: chosen[i])} AS x, {case(strict)} AS strictest FROM t)
    SELECT doc_id, x IS NOT NULL AS valid, x.id AS spdx_id, x.r AS rank, strictest, coalesce(x.base IN ({sql_list(license_ids.COPYLEFT)}), false) AS copyleft FROM x"""


@query(_sql_expressions())
def license_expressions(spark, sf_dir):
    n = F.col("doc_id")
    stated = _of(_SHAPES, n)
    for name, shift in (("{a}", 0), ("{b}", 1), ("{c}", 3)):
        stated = F.replace(stated, F.lit(name), _of(_IDS, n, shift))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("SPDX-License-Expression: "), stated, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    found = docs.select("doc_id", spdx.evaluate(F.regexp_extract("text", r"^SPDX-License-Expression: ([^\n]*)", 1)).alias("e"))
    return found.select("doc_id", "e.*")


# --- the verdict index: a third of the documents have a record, a third one of an older scanner

_INDEX_SQL = f"""lines AS {_LINES_BY_DOC}, {_WHOLE}, judged AS (SELECT doc_id, sha256(doc_id::VARCHAR || chr(0) || sha256(coalesce(text, ''))) AS bundle_hash, CASE WHEN coalesce(r, 0) >= 4 THEN 'block' WHEN coalesce(r, 0) >= 2 THEN 'review' ELSE 'pass' END AS verdict FROM documents LEFT JOIN worst ON bundle_id = doc_id::VARCHAR)"""


def _index(spark, sf_dir):
    files = _doc_files(read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))))
    hashes = scan.bundle_hashes(files.select("bundle_id", "path", F.sha2("content", 256).alias("sha256"))).withColumn("n", F.col("bundle_id").cast("long"))
    version = F.when(F.col("n") % 3 == 0, "2").otherwise("1")
    first = hashes.filter("n % 3 < 2").select((F.col("n") * 2).alias("position"), "bundle_hash", version.alias("scanner_version"), F.lit("r").alias("ruleset_version"), F.lit("kept").alias("verdict"), F.lit("before").alias("scanned_at"))
    again = first.withColumns({"position": F.col("position") + 1, "verdict": F.lit("second"), "scanner_version": F.lit("2")})
    return first.unionByName(again), files


@query(f"WITH {_INDEX_SQL} SELECT bundle_hash, CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE verdict END AS verdict, CASE WHEN doc_id % 3 = 0 THEN 'before' ELSE 'now' END AS scanned_at FROM judged")
def index_update(spark, sf_dir):
    index, files = _index(spark, sf_dir)
    return scan.update_index(index, files, "2", "r", "now")[0].select("bundle_hash", "verdict", "scanned_at")


@query("SELECT count(*) FILTER (doc_id % 3 > 0) AS scanned_first, 0::BIGINT AS scanned_again FROM documents")
def index_update_twice(spark, sf_dir):
    """What a second run over the first one's index has left to scan."""
    index, files = _index(spark, sf_dir)
    merged, made = scan.update_index(index, files, "2", "r", "now")
    again = scan.update_index(merged.withColumn("position", F.lit(0)), files, "2", "r", "later")[1]
    return made.agg(F.count("*").alias("scanned_first")).crossJoin(again.agg(F.count("*").alias("scanned_again")))  # one row each


# --- code: each document is a file whose comments are its text

_SNIPPETS = [
    ("py", "import os as o\no.system('ls')\nx = 'os.system(1)'", [("python-os-system", 2)]), ("py", "from os import system as run\nrun('x'); eval(y)", [("python-eval", 2), ("python-os-system", 2)]),
    ("py", "import subprocess\nsubprocess.run(c, shell=True)\nsubprocess.run(c, shell=False)", [("python-subprocess-shell", 2)]), ("py", "import yaml\nyaml.load(f)\nyaml.load(f, Loader=yaml.SafeLoader)\nyaml.safe_load(f)", [("python-yaml-unsafe-load", 2)]),
    ("py", "from pickle import loads\nloads(b)\ndef exec_(): pass\nexec('1')", [("python-pickle-loads", 2), ("python-exec", 4)]), ("py", "'eval(x)'\n# eval(x)\nmodel.eval()", []), ("py", "def broken(:\n eval(x)", []),
    ("js", "eval(x);\nm.eval(x); // eval(y)\nvar s = 'eval(z)';", [("js-eval", 1)]), ("ts", "const cp = require('child_process');\ncp.exec(c);\n/* cp.exec(d)\n */ cp.spawn(c)", [("js-child-process", 2)]),
    ("js", "import p from \"node:child_process\";\nx.exec(c)\np.execSync(c)", [("js-child-process", 3)]), ("md", "eval(x)", []),
]
_EXPECTED = [(i, rule, line, code_rules.CODE_RULES[rule]) for i, (_, _, hits) in enumerate(_SNIPPETS) for rule, line in hits]


@query(
    f"""SELECT doc_id::VARCHAR AS bundle_id, 'code:' || rule AS rule_id, 'src/m' || doc_id || '.' || [{sql_list([e for e, _, _ in _SNIPPETS])}][doc_id % {len(_SNIPPETS)} + 1] || ':' || line AS locus, severity
    FROM documents JOIN (VALUES {", ".join(f"({i}, '{r}', {n}, '{sev}')" for i, r, n, sev in _EXPECTED)}) v(k, rule, line, severity) ON doc_id % {len(_SNIPPETS)} = k"""
)
def code_findings(spark, sf_dir):
    n = F.col("doc_id")
    end = _of([e for e, _, _ in _SNIPPETS], n)
    mark = F.when(end == "py", "# ").otherwise("// ")
    comment = F.concat(F.lit("\n"), mark, F.regexp_replace(F.coalesce("text", F.lit("")), F.lit(r"[\r\n\x00\x0B\x0C\x1C-\x1E\x85  ]+"), F.concat(F.lit("\n"), mark)))
    files = read(spark, sf_dir, "documents").select(n.cast("string").alias("bundle_id"), F.concat(F.lit("src/m"), n, F.lit("."), end).alias("path"), F.concat(_of([s for _, s, _ in _SNIPPETS], n), comment).alias("text"))
    return code_rules.code_findings(files).select("bundle_id", "rule_id", "locus", "severity")


# --- walks, owners, entries: documents as files of repositories

_FOLDERS = ["a", "a-b", "a.b", "A", "node_modules", "a b", "é", "build/x", "target"]
_NAMES = ["SKILL.md", "x", "x/y.py", "x-y", "LICENSE", ".git/config", "ünit.md", "x.d/dist/z"]


@query(
    f"""WITH f AS (SELECT doc_id // 40 AS bundle_id, {_sql_of(_FOLDERS)} || '/' || {_sql_of(_NAMES, "doc_id // 9")} || doc_id AS path FROM documents), k AS (SELECT bundle_id, path, string_split(path, '/') AS parts FROM f)
    SELECT bundle_id, path, row_number() OVER (PARTITION BY bundle_id ORDER BY parts)::INT AS position FROM k WHERE NOT list_has_any(parts, [{sql_list(R.IGNORED_FOLDERS)}]) AND bundle_id % 5 <> 3"""
)
def bundle_walk(spark, sf_dir):
    """Every fifth bundle lies below a folder that no walk enters."""
    n = F.col("doc_id")
    files = read(spark, sf_dir, "documents").select(F.floor(n / 40).alias("bundle_id"), F.concat(_of(_FOLDERS, n), F.lit("/"), _of(_NAMES, F.floor(n / 9)), n).alias("path"))
    return scan.bundle_walk(files, F.when(F.col("bundle_id") % 5 == 3, "/home/vendor/x").otherwise("/home/x")).select("bundle_id", "path", "position")


_PLACES = ["SKILL.md", "LICENSE", "src/a.py", "k/SKILL.md", "k/one.txt", "k/COPYING", "k/l/SKILL.md", "k/l/two.md", "k/m/three.md", "COPYING"]
_LICENSE_TEXTS = {1: "Permission is hereby granted, free of charge", 5: "GNU General Public License, version 3", 9: "Apache License Version 2.0"}
_HEAD = "'---\nname: n' || k || '-' || i || '\ndescription: d: ' || i || '\ntags: [x, ''y'', ]\n---\n'"
_TREE = f"""tree AS (SELECT 'own/r' || k AS repo, k, i, [{sql_list(_PLACES)}][i + 1] AS path, CASE WHEN i = 7 AND k % 6 = 1 THEN NULL WHEN i = 6 AND k % 6 = 2 THEN '' WHEN i IN (0, 3, 6) AND k % 6 <> 3 THEN {_HEAD} || t WHEN i = 1 THEN CASE WHEN k % 4 = 0 THEN '{_LICENSE_TEXTS[1]}' ELSE t END WHEN i = 5 THEN '{_LICENSE_TEXTS[5]}' WHEN i = 9 THEN '{_LICENSE_TEXTS[9]}' ELSE t END AS content
    FROM (SELECT doc_id // 10 AS k, doc_id % 10 AS i, 'text ' || doc_id || ' ' || md5(coalesce(text, '')) AS t FROM documents)),
    folders AS (SELECT repo, CASE i WHEN 0 THEN '' WHEN 3 THEN 'k' ELSE 'k/l' END AS owner FROM tree WHERE i IN (0, 3, 6)),
    owned AS (SELECT t.*, arg_max(f.owner, length(f.owner)) AS owner FROM tree t JOIN folders f ON f.repo = t.repo AND (f.owner = '' OR starts_with(t.path, f.owner || '/')) GROUP BY ALL)"""


def _tree(spark, sf_dir):
    """Repositories of ten documents each."""
    docs = read(spark, sf_dir, "documents").withColumns({"k": F.floor(F.col("doc_id") / 10), "i": F.col("doc_id") % 10, "t": F.concat(F.lit("text "), "doc_id", F.lit(" "), F.md5(F.coalesce("text", F.lit("")).cast("binary")))})
    k, i, t = F.col("k"), F.col("i"), F.col("t")
    head = F.concat(F.lit("---\nname: n"), k, F.lit("-"), i, F.lit("\ndescription: d: "), i, F.lit("\ntags: [x, 'y', ]\n---\n"), t)
    content = (
        F.when((i == 7) & (k % 6 == 1), None).when((i == 6) & (k % 6 == 2), "").when(i.isin(0, 3, 6) & (k % 6 != 3), head)
        .when(i == 1, F.when(k % 4 == 0, _LICENSE_TEXTS[1]).otherwise(t)).when(i == 5, _LICENSE_TEXTS[5]).when(i == 9, _LICENSE_TEXTS[9]).otherwise(t)
    )
    return docs.select(F.concat(F.lit("own/r"), k).alias("repo"), F.lit("main").alias("ref"), _of(_PLACES, i).alias("path"), content.cast("binary").alias("content"))


@query(f"WITH {_TREE} SELECT repo, path, owner FROM owned")
def tree_owners(spark, sf_dir):
    return catalog.owners(_tree(spark, sf_dir))


@query(
    f"""WITH {_TREE}, rel AS (SELECT *, CASE WHEN owner = '' THEN path ELSE substr(path, length(owner) + 2) END AS p FROM owned),
    e AS (SELECT repo, k, owner, count(*) AS n_files, count(*) FILTER (content IS NULL) AS missing, max(content) FILTER (p = 'SKILL.md') AS skill, sha256(string_agg(p || chr(0) || sha256(content), chr(10) ORDER BY p)) AS bundle_hash, arg_min(i, p) FILTER (p IN ('LICENSE', 'COPYING')) AS own FROM rel GROUP BY ALL),
    spdx AS (SELECT repo, arg_min(i, CASE path WHEN 'LICENSE' THEN 0 ELSE 3 END) AS top FROM tree WHERE path IN ('LICENSE', 'COPYING') GROUP BY repo),
    named AS (SELECT e.*, top, CASE WHEN top = 1 THEN CASE WHEN k % 4 = 0 THEN 'MIT' END WHEN top = 9 THEN 'Apache-2.0' END AS repo_spdx, CASE own WHEN 5 THEN 'GPL-3.0-only' WHEN 9 THEN 'Apache-2.0' WHEN 1 THEN CASE WHEN k % 4 = 0 THEN 'MIT' END END AS own_spdx FROM e LEFT JOIN spdx USING (repo))
    SELECT repo || CASE WHEN owner = '' THEN '' ELSE ':' || owner END AS id, CASE WHEN starts_with(skill, '---') THEN 'n' || k || '-' || CASE owner WHEN '' THEN 0 WHEN 'k' THEN 3 ELSE 6 END WHEN owner = '' THEN 'r' || k ELSE string_split(owner, '/')[-1] END AS name, coalesce(repo_spdx, own_spdx) AS spdx_id,
    CASE WHEN top IS NOT NULL OR own_spdx IS NOT NULL THEN 'license-file' END AS license_source, CASE WHEN starts_with(skill, '---') THEN 'd: ' || CASE owner WHEN '' THEN 0 WHEN 'k' THEN 3 ELSE 6 END ELSE '' END AS description, CASE WHEN starts_with(skill, '---') THEN 'x,y' ELSE '' END AS tags, n_files, 'base/' || repo || '/main' || CASE WHEN owner = '' THEN '' ELSE '/' || owner END AS fetch_base, bundle_hash
    FROM named WHERE missing = 0 AND skill <> ''"""
)
def crawl_entries(spark, sf_dir):
    entries = crawl.build_entries(_tree(spark, sf_dir), "base")
    return entries.select("id", "name", "spdx_id", "license_source", "description", F.array_join("tags", ",").alias("tags"), F.size("files").cast("long").alias("n_files"), "fetch_base", "bundle_hash")


_PATHS = ["a/b.md", "", "/a", "a//b", "../a", "a/./b", "a\\b", "c:x", "a/..b", "a/", "..", "ä b/c"]


@query(f"SELECT doc_id, {_sql_of(_PATHS)} NOT IN ('', '/a', 'a//b', '../a', 'a/./b', 'a\\b', 'c:x', 'a/', '..') AS safe FROM documents")
def safe_paths(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", catalog.safe_path(_of(_PATHS, F.col("doc_id"))).alias("safe"))


@query("SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(url, '/', ','), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM pages")
def list_fields(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", F.array_join(catalog.as_list(F.concat(F.lit(" [ "), F.replace("url", F.lit("/"), F.lit(" , ")), F.lit("] "))), "|").alias("parts"))


# --- files of bundles: what is read, what kind it is, what a repository's files say

_ENDS = [".py", ".MD", ".txt", ".bin", ".js", "/package.json", "/requirements-dev.txt", "/Pipfile"]
_FILE_KIND = _KIND.replace("path", "regexp_extract(p, '[^/]*$')")


@query(
    f"""WITH f AS (SELECT doc_id, 'd' || doc_id || {_sql_of(_ENDS)} AS p, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
    SELECT doc_id::VARCHAR AS bundle_id, CASE WHEN doc_id % 13 = 4 AND n > 0 THEN 'binary' WHEN n > 20000 THEN 'large' WHEN p LIKE '%/package.json' OR p LIKE '%.txt' AND p LIKE '%/requirements%' OR p LIKE '%/Pipfile' THEN 'manifest' WHEN p LIKE '%.py' OR p LIKE '%.js' THEN 'script' WHEN lower(p) LIKE '%.md' OR p LIKE '%.txt' THEN 'markdown' ELSE 'other' END AS kind FROM f WHERE NOT (n > 20000 AND doc_id % 13 = 4)"""
)
def readable_files(spark, sf_dir):
    """Documents as files, some with a NUL and so left out, those over 20,000 bytes with a notice alone."""
    n = F.col("doc_id")
    text = F.coalesce("text", F.lit("")).cast("binary")
    files = read(spark, sf_dir, "documents").select(n.cast("string").alias("bundle_id"), F.concat(F.lit("d"), n, _of(_ENDS, n)).alias("path"), F.when(n % 13 == 4, F.concat(F.lit(b"\0"), text)).otherwise(text).alias("content"), F.octet_length(text).alias("n"))
    files = files.filter((F.col("n") <= 20000) | (F.col("bundle_id").cast("long") % 13 != 4))
    texts, notices = scan.readable(files.drop("n"), 20_000)
    read_ = texts.select("bundle_id", "kind").union(notices.select("bundle_id", F.lit("large")))
    binary = files.join(read_, "bundle_id", "left_anti").filter("n > 0").select("bundle_id", F.lit("binary"))
    return read_.union(binary).union(files.join(read_, "bundle_id", "left_anti").filter("n = 0").select("bundle_id", scan.file_kind("path")))


_TOPS = ["src/", "tests/", "", "docs/"]
_FILES_OF = ["a.py", "go.mod", "README.md", "b.RS", "ruff.toml", "requirements.txt", "c.tsx", "package.json", ".hidden"]


@query(
    f"""WITH f AS (SELECT doc_id, {_sql_of(_TOPS, "doc_id // 9")} || {_sql_of(_FILES_OF)} AS path FROM documents), m AS (SELECT DISTINCT path FROM f WHERE regexp_matches(path, '(go.mod|requirements.txt|package.json)$'))
    SELECT (SELECT string_agg(path, ' ' ORDER BY path) FROM m) AS manifests, (SELECT string_agg(DISTINCT left(path, strpos(path, '/') - 1), ' ' ORDER BY left(path, strpos(path, '/') - 1)) FROM f WHERE contains(path, '/')) AS top_dirs, (SELECT string_agg(DISTINCT 'ruff', ' ') FROM f WHERE path LIKE '%ruff.toml') AS config_files,
    (SELECT string_agg(DISTINCT d, ' ' ORDER BY d) FROM (SELECT unnest(CASE WHEN path LIKE '%go.mod' THEN ['ex.org/m' || doc_id % 7] WHEN path LIKE '%.txt' THEN ['pkg-' || doc_id % 5, 'flask'] WHEN path LIKE '%.json' THEN ['dep' || doc_id % 3] END) AS d FROM f)) AS dependencies, (SELECT bool_or(contains(path, 'test') AND regexp_matches(lower(path), '\\.(py|rs)$')) FROM f) AS has_tests,
    (SELECT count(*) FROM f WHERE lower(path) LIKE '%.rs') AS n_rust"""
)
def repository_evidence(spark, sf_dir):
    n = F.col("doc_id")
    path = F.concat(_of(_TOPS, F.floor(n / 9)), _of(_FILES_OF, n))
    content = (
        F.when(path.endswith("go.mod"), F.concat(F.lit("module x\n\ngo 1.2\nrequire (\n\tex.org/m"), n % 7, F.lit(" v1 // note\n)\n")))
        .when(path.endswith(".txt"), F.concat(F.lit("# c\n-r other\n  Pkg-"), n % 5, F.lit(">=1\nflask\n")))
        .when(path.endswith(".json"), F.concat(F.lit('{"dependencies": {"dep'), n % 3, F.lit('": "1"}}'))).otherwise(F.coalesce("text", F.lit("")))
    )
    found = repository.evidence(read(spark, sf_dir, "documents").select(path.alias("path"), content.cast("binary").alias("content")), "r")
    joined = {c: F.array_join(c, " ") for c in ("manifests", "top_dirs", "config_files", "dependencies")}
    return found.select(*(v.alias(k) for k, v in joined.items()), "has_tests", F.element_at("file_counts", F.lit(".rs")).alias("n_rust"))


# --- outputs: rendered texts, trees, payloads, warnings


def _outputs(spark, sf_dir):
    n = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), n).alias("name"), F.when(n % 7 != 0, F.concat(F.lit(" about "), F.lower("lang"), F.repeat(F.lit("x"), (n % 4 * 500).cast("int")))).alias("description"), F.when(n % 3 == 0, "MIT").alias("license"), F.lit(None).cast("string").alias("compatibility"), F.when(n % 5 == 0, "Read Edit").alias("allowed_tools"), F.lit("").alias("disallowed_tools"),
        (n % 11 == 0).alias("disable_model_invocation"), F.when(n % 2 == 0, F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), n.cast("string"))).alias("metadata"), F.concat(F.when(n % 4 == 0, "\n").otherwise(""), F.coalesce("text", F.lit("")), F.when(n % 3 == 1, F.concat(F.lit(" see scripts/run"), n % 2, F.lit(".sh"))).otherwise("")).alias("body"),
    )


_OUTPUTS = """outputs AS (SELECT doc_id, 'd' || doc_id AS name, CASE WHEN doc_id % 7 <> 0 THEN ' about ' || lower(lang) || repeat('x', (doc_id % 4 * 500)::INT) END AS description, CASE WHEN doc_id % 4 = 0 THEN chr(10) ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 3 = 1 THEN ' see scripts/run' || doc_id % 2 || '.sh' ELSE '' END AS body FROM documents),
    rendered AS (SELECT doc_id, name, description, body, '---' || chr(10) || 'name: ' || name || chr(10) || coalesce('description: ' || trim(description) || chr(10), '') || CASE WHEN doc_id % 3 = 0 THEN 'license: MIT' || chr(10) ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN 'allowed-tools: Read Edit' || chr(10) ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN 'disable-model-invocation: true' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 2 = 0 THEN 'metadata:' || chr(10) || '  a: ' || doc_id || chr(10) || '  b: 2' || chr(10) ELSE '' END || '---' || chr(10) || CASE WHEN starts_with(body, chr(10)) THEN '' ELSE chr(10) END || body AS text FROM outputs)"""


@query(f"WITH {_OUTPUTS} SELECT name || '/SKILL.md' AS path, sha256(text) AS sha256 FROM rendered UNION ALL SELECT name || '/scripts/run0.sh', sha256('echo ' || doc_id) FROM outputs WHERE doc_id % 3 = 1 AND doc_id % 2 = 0")
def tree_files(spark, sf_dir):
    """Rendered outputs, and of each bundle's two scripts the one that exists and is named."""
    docs = _outputs(spark, sf_dir)
    bundles = docs.select("name", F.lit("scripts/run0.sh").alias("path"), F.concat(F.lit("echo "), F.substring("name", 2, 20)).cast("binary").alias("content"))
    return emit.tree_files(docs, bundles).select("path", F.sha2("content", 256).alias("sha256"))


@query(f"WITH {_OUTPUTS} SELECT name FROM outputs WHERE trim(coalesce(description, '')) = ''")
def emit_blockers(spark, sf_dir):
    return emit.blockers(_outputs(spark, sf_dir))


@query(
    f"""WITH {_OUTPUTS} SELECT name, 'tool fields aren''t enforced' AS warning FROM outputs WHERE doc_id % 5 = 0 OR doc_id % 11 = 0 UNION ALL SELECT name, 'support files aren''t in the payload' FROM outputs WHERE regexp_matches(body, '(references|scripts|assets)/[a-zA-Z0-9_./-]')
    UNION ALL SELECT name, 'description is cut in listings' FROM outputs WHERE length(description) > 1536 UNION ALL SELECT name, 'description is too long for the API' FROM outputs WHERE length(description) > 1024"""
)
def surface_warnings(spark, sf_dir):
    return emit.surface_warnings(_outputs(spark, sf_dir))


@query(f"WITH {_OUTPUTS} SELECT name AS slug, name AS display_name, description, sha256(text) AS content FROM rendered")
def api_payload(spark, sf_dir):
    payload = F.from_json("payload", "name string, display_name string, description string, content string")
    return emit.api_payload(_outputs(spark, sf_dir)).select(payload.alias("p")).select(F.col("p.name").alias("slug"), "p.display_name", "p.description", F.sha2(F.col("p.content").cast("binary"), 256).alias("content"))


@query("SELECT 'd' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'MIT' WHEN doc_id % 3 = 1 THEN 'ISC' END AS license FROM documents")
def license_stamp(spark, sf_dir):
    n = F.col("doc_id")
    sources = read(spark, sf_dir, "documents").select(F.concat(F.lit(" D"), n, F.lit("!")).alias("name"), F.when(n % 3 == 0, "MIT").when(n % 3 == 1, "ISC").alias("spdx_id"))
    return emit.stamp_licenses(_outputs(spark, sf_dir), sources).select("name", "license")


# --- reports of other scanners


@query(
    """SELECT doc_id::VARCHAR AS bundle_id, CASE WHEN doc_id % 5 = 4 THEN 'core:scanner-notice' ELSE 'bandit:B' || doc_id % 9 END AS rule_id, CASE WHEN doc_id % 5 = 4 THEN 'info' ELSE ['high', 'medium', 'low', 'low'][doc_id % 4 + 1] END AS severity, CASE WHEN doc_id % 5 = 4 THEN '-' ELSE 'f.py:' || doc_id END AS locus FROM documents
    UNION ALL SELECT doc_id::VARCHAR, 'gitleaks:r' || doc_id % 3, 'high', 'k:' || doc_id FROM documents"""
)
def scanner_reports(spark, sf_dir):
    n = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id", n.cast("string").alias("bundle_id"), "text")
    hit = F.struct(F.concat(F.lit("B"), n % 9).alias("test_id"), _of(["HIGH", "medium", "LOW", "odd"], n).alias("issue_severity"), F.substring("text", 1, 40).alias("issue_text"), F.lit("f.py").alias("filename"), n.cast("int").alias("line_number"))
    bandit = docs.select("bundle_id", F.when(n % 5 == 4, "Traceback: no JSON").otherwise(F.to_json(F.struct(F.array(hit).alias("results")))).alias("json"))
    leak = F.struct(F.concat(F.lit("r"), n % 3).alias("RuleID"), F.lit("d").alias("Description"), F.lit("k").alias("File"), n.cast("int").alias("StartLine"), F.col("text").alias("Secret"))
    return scan.parse_reports(bandit, "bandit").unionByName(scan.parse_reports(docs.select("bundle_id", F.to_json(F.array(leak)).alias("json")), "gitleaks")).select("bundle_id", "rule_id", "severity", "locus")


# --- grouping and pruning of documents as atoms


@query("SELECT doc_id::VARCHAR AS atom_id, source AS \"group\", CASE WHEN doc_id % 3 = 0 THEN 'directive' WHEN doc_id % 2 = 0 THEN 'example' ELSE 'context' END AS kind, doc_id % 3 = 0 AND doc_id % 2 = 1 AS forced FROM documents")
def validate_grouping(spark, sf_dir):
    n = F.col("doc_id")
    docs = read(spark, sf_dir, "documents")
    atoms = docs.select(n.cast("string").alias("id"), F.when(n % 3 == 0, "directive").otherwise("context").alias("detected_kind"))
    given = docs.select(n.cast("string").alias("atom_id"), F.col("source").alias("group"), F.when((n % 3 == 0) & (n % 2 == 0), "directive").when(n % 2 == 0, "example").otherwise("context").alias("kind"))
    return merge.validate_grouping(atoms, given)


@query("SELECT doc_id::VARCHAR AS atom_id, source AS \"group\", CASE WHEN doc_id % 4 = 0 THEN 'trigger' ELSE 'context' END AS kind FROM documents")
def default_grouping(spark, sf_dir):
    n = F.col("doc_id")
    return merge.default_grouping(read(spark, sf_dir, "documents").select(n.cast("string").alias("id"), F.col("source").alias("skill"), F.when(n % 4 == 0, "trigger").alias("detected_kind")))


@query(
    """WITH RECURSIVE a AS (SELECT doc_id AS id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: w IN ('license', 'erin', 'que'))) > 0 AS hit, doc_id % 10 = 9 AS lost FROM documents),
    kept AS (SELECT id FROM a WHERE hit AND NOT lost UNION SELECT a.id FROM kept k JOIN a ON a.id = k.id + 1 AND k.id % 10 < 8)
    SELECT a.id, CASE WHEN k.id IS NOT NULL THEN 'kept' ELSE 'dropped' END AS status, CASE WHEN k.id IS NULL THEN CASE WHEN lost THEN 'conflict-loser' ELSE 'out-of-scope' END END AS reason FROM a LEFT JOIN kept k ON a.id = k.id"""
)
def prune_and_close(spark, sf_dir):
    """Of ten documents in a row each but the last two depends on the next one, and the last has lost a conflict."""
    n = F.col("doc_id")
    docs = read(spark, sf_dir, "documents")
    edges = docs.filter(n % 10 < 8).select(n.alias("src_atom_id"), F.lit("x").alias("target_ref"), (n + 1).alias("resolved_atom_id"), F.lit("atom").alias("kind"))
    return merge.prune_and_close(docs.select(n.alias("id"), "text"), ["license", "erin", "que"], edges, docs.filter(n % 10 == 9).select(n.alias("id")))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'heading' WHEN doc_id % 6 = 1 THEN 'example' WHEN doc_id % 6 = 2 THEN 'directive' WHEN doc_id % 6 IN (3, 4) THEN 'trigger' ELSE 'context' END AS kind FROM documents"""
)
def detected_kinds(spark, sf_dir):
    n = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(n % 6 == 0, "heading").when(n % 6 == 1, "fence").otherwise("paragraph").alias("block"), F.concat(_of(["Always ", "never ", "- Make sure that ", "  When ", "use this skill to ", "§ "], n), F.coalesce("text", F.lit(""))).alias("text"))
    return docs.select("doc_id", merge.detected_kind("block", "text").alias("kind"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'cat' || doc_id ELSE 'own' END AS name, CASE WHEN doc_id % 4 = 0 THEN 'repo/' || source END AS repo, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'MIT' END ELSE 'local' END AS spdx_id FROM documents")
def catalog_identity(spark, sf_dir):
    """Every fourth document's bundle is in a catalog, each hash twice; others have an empty hash there."""
    n = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").withColumn("bundle_hash", F.sha2(F.concat(n.cast("string"), F.coalesce("text", F.lit(""))).cast("binary"), 256))
    entries = docs.select("doc_id", F.when(n % 4 == 0, F.col("bundle_hash")).otherwise("").alias("bundle_hash"), F.concat(F.lit("cat"), n).alias("name"), F.concat(F.lit("repo/"), "source").alias("repo"), F.lit(None).cast("string").alias("url"), F.when(n % 8 == 0, "MIT").alias("spdx_id"), (n * 2 + 1).alias("position"))
    older = entries.withColumns({"name": F.lit("older"), "position": n * 2})
    bundles = docs.select("doc_id", "bundle_hash", F.lit("own").alias("name"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("url"), F.lit("local").alias("spdx_id"))
    return catalog.carry_identity(bundles, older.unionByName(entries).drop("doc_id")).select("doc_id", "name", "repo", "spdx_id")


# --- Markdown: each document between a heading, a directive, a list and a quotation

_WORDS_ONLY = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'))"


@query(
    f"""WITH m AS (SELECT doc_id::VARCHAR AS skill, '# T' || doc_id || chr(10) AS h, 'Always keep x' || doc_id || chr(10) AS d, '- one ' || doc_id || chr(10) AS one, '- when two' || chr(10) AS two, '> q' || chr(10) AS q, 'p ' || {_WORDS_ONLY} || chr(10) AS p FROM documents),
    parts AS (SELECT skill, unnest([{{'path': 'h0', 'at': 0, 'n': 0, 'text': h, 'kind': 'heading'}}, {{'path': 'p1', 'at': length(h) + 1, 'n': 1, 'text': d, 'kind': 'directive'}}, {{'path': 'l2/i0/p0', 'at': length(h || d) + 2, 'n': 2, 'text': one, 'kind': 'context'}}, {{'path': 'l2/i1/p0', 'at': length(h || d || one) + 2, 'n': 3, 'text': two, 'kind': 'context'}},
    {{'path': 'q3/p0', 'at': length(h || d || one || two) + 3, 'n': 4, 'text': q, 'kind': 'context'}}, {{'path': 'p4', 'at': length(h || d || one || two || q) + 4, 'n': 5, 'text': p, 'kind': 'context'}}]) AS a FROM m)
    SELECT skill || ':' || a.path || ':' || left(sha256(a.text), 16) AS id, skill, a.path AS path, a.at::BIGINT AS start, (a.at + length(a.text))::BIGINT AS "end", a.n AS source_order, a.kind AS detected_kind FROM parts"""
)
def markdown_atoms(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    body = F.concat(F.lit("# T"), n, F.lit("\n\nAlways keep x"), n, F.lit("\n\n- one "), n, F.lit("\n- when two\n\n> q\n\np "), words, F.lit("\n"))
    atoms = markdown.parse_atoms(read(spark, sf_dir, "documents").select(n.alias("skill"), body.alias("body")))
    return atoms.select("id", "skill", "path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("source_order").cast("int").alias("source_order"), "detected_kind")
