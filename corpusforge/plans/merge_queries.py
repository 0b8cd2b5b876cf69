"""Queries of merging whose rows come from documents: frontmatter carry and the proof of outputs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusforge.operators import merge, verify
from corpusforge.plans.registry import query, read
from corpusforge.sources import frontmatter

# --- frontmatter: each document is a source that opens with fields of its own; outputs draw on 50 documents each

_OUTPUT = "'out' || lpad((doc_id // 50)::VARCHAR, 9, '0')"
_HEADS = f"""heads AS (SELECT doc_id, lpad(doc_id::VARCHAR, 12, '0') AS skill, {_OUTPUT} AS cluster,
    CASE WHEN doc_id % 3 <> 0 THEN list_filter(['Read', CASE WHEN doc_id % 50 <> 7 THEN 'Edit' END, CASE WHEN lang = 'en' THEN 'Bash(git add *)' END], lambda x: x IS NOT NULL) END AS allowed,
    CASE WHEN doc_id % 26 = 0 THEN ['Web', 'Write'] WHEN doc_id % 13 = 0 THEN ['Web'] END AS disallowed, doc_id % 40 = 1 AS disable,
    CASE WHEN doc_id % 35 = 0 THEN 'node' WHEN doc_id % 5 = 0 THEN 'py3' END AS compatibility, CASE WHEN doc_id % 10 = 3 THEN 'team' || doc_id % 4 END AS owner FROM documents)"""
_CARRIED = """declaring AS (SELECT cluster, count(*) FILTER (allowed IS NOT NULL) AS n FROM heads GROUP BY cluster),
    tools AS (SELECT cluster, token, count(*) AS n FROM (SELECT cluster, unnest(allowed) AS token FROM heads) GROUP BY ALL),
    allowed AS (SELECT t.cluster, string_agg(token, ' ' ORDER BY token) FILTER (t.n = d.n) AS yes, string_agg(token, ', ' ORDER BY token) FILTER (t.n < d.n) AS no FROM tools t JOIN declaring d USING (cluster) GROUP BY t.cluster),
    denied AS (SELECT cluster, string_agg(DISTINCT token, ' ' ORDER BY token) AS v FROM (SELECT cluster, unnest(disallowed) AS token FROM heads) GROUP BY cluster),
    fits AS (SELECT cluster, string_agg(compatibility, '; ' ORDER BY first) AS v, count(*) AS n FROM (SELECT cluster, compatibility, min(doc_id) AS first FROM heads WHERE compatibility IS NOT NULL GROUP BY ALL) GROUP BY cluster),
    owners AS (SELECT cluster, arg_min(owner, doc_id) AS v, count(DISTINCT owner) AS n FROM heads WHERE owner IS NOT NULL GROUP BY cluster),
    carried AS (SELECT cluster, 'allowed-tools' AS field, yes AS value FROM allowed WHERE yes IS NOT NULL UNION ALL SELECT cluster, 'disallowed-tools', v FROM denied
    UNION ALL SELECT DISTINCT cluster, 'disable-model-invocation', 'true' FROM heads WHERE disable UNION ALL SELECT cluster, 'compatibility', v FROM fits
    UNION ALL SELECT cluster, 'metadata', '{"kind":"a","owner":"' || v || '"}' FROM owners)"""


def _sources(spark, sf_dir):
    n = F.col("doc_id")
    line = lambda key, when, value: F.when(when, F.concat(F.lit(f"{key}: "), value, F.lit("\n"))).otherwise("")
    tools = F.concat(F.lit("Read"), F.when(n % 50 != 7, ", Edit").otherwise(""), F.when(F.col("lang") == "en", " Bash(git add *)").otherwise(""))
    head = F.concat(
        F.lit("---\nname: x\n"), line("allowed-tools", n % 3 != 0, tools), line("disallowed-tools", n % 13 == 0, F.when(n % 26 == 0, "Web, Write").otherwise("Web")),
        line("disable-model-invocation", n % 40 == 1, F.lit("True")), line("compatibility", n % 5 == 0, F.when(n % 35 == 0, "node").otherwise("py3")),
        F.when(n % 10 == 3, F.concat(F.lit("metadata:\n  owner: team"), n % 4, F.lit("\n  kind: a\n"))).otherwise(""), F.lit("---\n"),
    )
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lpad(n.cast("string"), 12, "0").alias("skill"), n.alias("source_order"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    return frontmatter.split_frontmatter(docs)


def _output():
    return F.concat(F.lit("out"), F.lpad(F.floor(F.col("doc_id") / 50).cast("string"), 9, "0"))


def _layout_and_atoms(sources):
    atoms = sources.select("doc_id", F.concat("skill", F.lit(":p0:x")).alias("id"), "skill", F.col("body").alias("text"))
    return atoms.select(_output().alias("cluster"), F.col("id").alias("atom_id"), "doc_id"), atoms.drop("doc_id")


def _carried(sources):
    layout, atoms = _layout_and_atoms(sources)
    return frontmatter.carried_fields(frontmatter.contributing_sources(layout, atoms), sources)


@query(f"WITH {_HEADS}, {_CARRIED} SELECT cluster, field, value FROM carried")
def frontmatter_carry(spark, sf_dir):
    return _carried(_sources(spark, sf_dir))


@query(
    f"""WITH {_HEADS}, {_CARRIED} SELECT cluster, 'merge:allowed-tools-narrowed' AS rule_id, 'medium' AS severity, 'not allowed by every source: ' || no AS message FROM allowed WHERE no IS NOT NULL
    UNION ALL SELECT cluster, 'merge:disallowed-tools-joined', NULL, 'disallowed by any source: ' || v FROM denied
    UNION ALL SELECT cluster, 'merge:invocation-disabled', 'medium', 'disabled by: ' || string_agg(skill, ', ' ORDER BY skill) FROM heads WHERE disable GROUP BY cluster
    UNION ALL SELECT cluster, 'merge:compatibility-joined', NULL, 'from more than one source' FROM fits WHERE n > 1
    UNION ALL SELECT cluster, 'merge:metadata-differs', NULL, 'kept the first source''s owner' FROM owners WHERE n > 1"""
)
def frontmatter_findings(spark, sf_dir):
    sources = _sources(spark, sf_dir)
    layout, atoms = _layout_and_atoms(sources)
    return frontmatter.carry_findings(frontmatter.contributing_sources(layout, atoms), sources)


@query(f"WITH {_HEADS} SELECT DISTINCT cluster AS child, skill FROM heads")
def contributing_sources(spark, sf_dir):
    return frontmatter.contributing_sources(*_layout_and_atoms(_sources(spark, sf_dir)))


@query(
    f"""WITH {_HEADS}, f AS (SELECT cluster, allowed, allowed IS NOT NULL AS says FROM heads) SELECT cluster AS child, count(*) FILTER (says) AS declaring, (SELECT string_agg(token, ' ' ORDER BY token) FROM (SELECT DISTINCT unnest(g.allowed) AS token FROM f g WHERE g.cluster = f.cluster)) AS every_tool FROM f GROUP BY cluster"""
)
def frontmatter_tools(spark, sf_dir):
    """Tools that any source of an output declares, read from the fields' text."""
    told = frontmatter.declared(_sources(spark, sf_dir)).withColumn("child", _output())
    tokens = told.select("child", F.explode("allowed").alias("token")).distinct().groupBy("child").agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("every_tool"))
    return told.groupBy("child").agg(F.count("allowed").alias("declaring")).join(tokens, "child", "left")


@query(r"SELECT doc_id, length(coalesce(text, '')) AS body_chars, to_json(list_sort(list_filter(['name', CASE WHEN doc_id % 3 <> 0 THEN 'allowed-tools' END, CASE WHEN doc_id % 13 = 0 THEN 'disallowed-tools' END, CASE WHEN doc_id % 40 = 1 THEN 'disable-model-invocation' END, CASE WHEN doc_id % 5 = 0 THEN 'compatibility' END, CASE WHEN doc_id % 10 = 3 THEN 'metadata' END], lambda x: x IS NOT NULL)))::VARCHAR AS keys FROM documents")
def frontmatter_split(spark, sf_dir):
    return _sources(spark, sf_dir).select("doc_id", F.length("body").cast("long").alias("body_chars"), F.to_json(F.array_sort(F.json_object_keys("frontmatter"))).alias("keys"))


# --- proof of outputs: bodies of 50 documents, with a problem of each kind planted by the output's number


@query(
    f"""WITH {_HEADS}, {_CARRIED}, c AS (SELECT doc_id, skill || ':p0:x' AS atom_id, cluster, (doc_id // 50) % 11 AS k, row_number() OVER (PARTITION BY cluster ORDER BY doc_id) AS n, coalesce(text, '') AS text FROM documents JOIN heads USING (doc_id)),
    bodies AS (SELECT cluster, k, string_agg(text, chr(10) ORDER BY doc_id) AS body, count(*) AS n FROM c GROUP BY ALL)
    SELECT 'unknown atom' AS problem, cluster, 'nowhere ' || cluster AS item FROM c WHERE k = 2 AND n = 1 UNION ALL SELECT 'unknown scaffold', cluster, 'glue' FROM bodies WHERE k = 3 AND n > 1
    UNION ALL SELECT 'body differs from its atoms', cluster, '' FROM bodies WHERE k IN (1, 5) OR (k = 6 AND body <> '') UNION ALL SELECT 'atom in more than one place', NULL, atom_id FROM c WHERE k = 4 AND n = 1
    UNION ALL SELECT 'dropped without a reason', NULL, doc_id::VARCHAR FROM documents WHERE doc_id % 97 = 5 AND doc_id % 2 = 0
    UNION ALL SELECT 'frontmatter differs from its sources', cluster, field FROM carried JOIN bodies USING (cluster) WHERE k = 7
    UNION ALL SELECT 'frontmatter without a source', cluster, 'compatibility' FROM bodies WHERE k = 8 AND cluster NOT IN (SELECT cluster FROM fits)
    UNION ALL SELECT 'frontmatter differs from its sources', cluster, 'compatibility' FROM bodies WHERE k = 8 AND cluster IN (SELECT cluster FROM fits)
    UNION ALL SELECT 'router missing', 'orchestrator', '' FROM (SELECT count(*) AS n FROM bodies) WHERE n > 1"""
)
def verify_documents(spark, sf_dir):
    sources = _sources(spark, sf_dir)
    placed, atoms = _layout_and_atoms(sources)
    k = (F.floor(F.substring("cluster", 4, 9).cast("long")) % 11).cast("int")
    placed = placed.withColumn("position", F.row_number().over(Window.partitionBy("cluster").orderBy("doc_id")))
    twice = placed.groupBy("cluster").agg(F.min_by("atom_id", "position").alias("atom_id"), (F.max("position") + 1).alias("position")).filter(k == 4)
    placed = placed.drop("doc_id").unionByName(twice)
    layout = verify.slots(placed)
    texts = placed.join(atoms.select(F.col("id").alias("atom_id"), "text"), "atom_id")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x.text), "\n")
    half = F.floor(F.length("body") / 2).cast("int")
    changed = F.when(k == 1, F.concat("body", F.lit("x"))).when(k == 5, F.concat(F.substring("body", F.lit(1), half), F.lit("~"), F.substring("body", half + 1, F.length("body")))).when(k == 6, F.left("body", F.length("body") - 1)).otherwise(F.col("body"))
    expected = _carried(sources)
    fields = F.map_from_entries(F.collect_list(F.struct("field", F.when(k == 7, F.concat("value", F.lit(" more"))).otherwise(F.col("value")).alias("value"))))
    given = expected.filter(~((k == 8) & (F.col("field") == "compatibility"))).groupBy("cluster").agg(fields.alias("fields"))
    outputs = texts.groupBy("cluster").agg(body.alias("body")).withColumn("body", changed).join(given, "cluster", "left")
    none = F.create_map().cast("map<string,string>")
    outputs = outputs.withColumn("fields", F.when(k == 8, F.map_concat(F.coalesce("fields", none), F.create_map(F.lit("compatibility"), F.lit("invented")))).otherwise(F.coalesce("fields", none)))
    layout = layout.withColumn("atom_id", F.when((k == 2) & (F.col("position") == 0), F.concat(F.lit("nowhere "), "cluster")).otherwise(F.col("atom_id"))).withColumn("template_id", F.when((k == 3) & (F.col("position") == 1), "glue").otherwise(F.col("template_id")))
    dropped = read(spark, sf_dir, "documents").filter("doc_id % 97 = 5").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 2 != 0, "out-of-scope").alias("reason"))
    empty = {n: spark.createDataFrame([], s) for n, s in (("router", "body string"), ("router_slots", "role string, template_id string"), ("routes", "position int, label string, skill_name string"))}
    return verify.verify_all(outputs, layout, atoms, dropped, **empty, expected=expected)


@query(
    """WITH o AS (SELECT label, row_number() OVER (ORDER BY label) AS position FROM (SELECT DISTINCT coalesce(lang, '') AS label FROM documents))
    SELECT 'router differs from its routes' AS problem, 'orchestrator' AS cluster, '' AS item FROM o HAVING count(*) > 1 UNION ALL SELECT 'unknown scaffold', 'orchestrator', 'route2' FROM o WHERE position = 2 UNION ALL SELECT 'router for one output', 'orchestrator', '' FROM o HAVING count(*) = 1"""
)
def verify_router(spark, sf_dir):
    """A router over the languages of all documents, its second route in another template and one route's name changed."""
    outputs = read(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("cluster")).distinct()
    routes = outputs.select(F.row_number().over(Window.orderBy("cluster")).alias("position"), F.col("cluster").alias("label"), F.concat("cluster", F.lit("-x")).alias("skill_name"))
    router = merge.router(outputs.withColumn("name", F.col("cluster")))
    slots = routes.select(F.lit("scaffold").alias("role"), F.when(F.col("position") == 2, "route2").otherwise(verify.ROUTE_SLOT).alias("template_id"))
    return verify.router_problems(outputs, router, slots, routes)
