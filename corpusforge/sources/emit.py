"""Sinks: rendered documents as trees, zip archives and payloads, with their provenance."""

from __future__ import annotations

import io
import json
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import slug
from corpusforge.operators.evaluate import API_LIMIT, LISTING_LIMIT
from corpusforge.operators.merge import contributors, drop_summary
from corpusforge.sources.frontmatter import CARRIED
from corpusforge.sources.tree_sink import write_files

REFERENCE_FILE = r"((?:references|scripts|assets)/[\w./-]+)"
# Names that a marketplace may not claim.
RESERVED_MARKETPLACES = [
    "claude-code-marketplace", "claude-code-plugins", "claude-plugins-official", "claude-plugins-community", "claude-community", "anthropic-marketplace", "anthropic-plugins",
    "agent-skills", "anthropic-agent-skills", "knowledge-work-plugins", "life-sciences", "claude-for-legal", "claude-for-financial-services", "financial-services-plugins",
]


SHARING_NOTE = "What is uploaded can be used by everyone in the workspace."


class EmitError(ValueError):
    """Outputs that can't be written as they are."""


def _line(key: str, value: str) -> Column:
    text = F.trim(F.coalesce(F.col(value), F.lit("")))
    return F.when(text != "", F.concat(F.lit(f"{key}: "), text, F.lit("\n"))).otherwise("")


def render(docs: DataFrame) -> DataFrame:
    """name and text of documents (name, description, license, compatibility, allowed_tools, disallowed_tools,
    disable_model_invocation, metadata map, body): frontmatter in a fixed order, a blank line, the body."""
    metadata = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(F.lit("  "), e.key, F.lit(": "), e.value, F.lit("\n"))), "")
    text = F.concat(
        F.lit("---\nname: "), "name", F.lit("\n"), _line("description", "description"), _line("license", "license"), _line("compatibility", "compatibility"),
        _line("allowed-tools", "allowed_tools"), _line("disallowed-tools", "disallowed_tools"),
        F.when(F.coalesce("disable_model_invocation", F.lit(False)), "disable-model-invocation: true\n").otherwise(""),
        F.when(F.size(F.coalesce("metadata", F.create_map().cast("map<string,string>"))) > 0, F.concat(F.lit("metadata:\n"), metadata)).otherwise(""),
        F.lit("---\n"), F.when(F.col("body").startswith("\n"), "").otherwise("\n"), "body",
    )
    return docs.select("name", text.alias("text"))


def blockers(docs: DataFrame) -> DataFrame:
    """Names of outputs without a description."""
    return docs.filter(F.trim(F.coalesce("description", F.lit(""))) == "").select("name")


def stamp_licenses(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """docs with the license (sources: name, spdx_id) of the source whose slug is their name."""
    known = sources.filter("spdx_id is not null").select(slug("name").alias("name"), F.col("spdx_id").alias("license")).dropDuplicates(["name"])
    return docs.drop("license").join(known, "name", "left")


def support_references(docs: DataFrame) -> DataFrame:
    """name and path of each support file that a body names."""
    return docs.select("name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(REFERENCE_FILE), 1))).alias("path"))


def carried_support(docs: DataFrame, bundles: DataFrame) -> DataFrame:
    """Referenced files that are in the bundle (name, path, content) of the output's name."""
    return bundles.join(support_references(docs), ["name", "path"], "left_semi")


def dangling_support(docs: DataFrame, bundles: DataFrame) -> DataFrame:
    """name and path of files that a body names and its bundle (name, path) doesn't have."""
    return support_references(docs).join(bundles.select("name", "path"), ["name", "path"], "left_anti")


def truncation(docs: DataFrame) -> DataFrame:
    """name, characters of the description, and the surface that cuts it: listings, else the API."""
    n = F.length(F.coalesce("description", F.lit(""))).cast("long")
    return docs.select("name", n.alias("chars"), F.when(n > LISTING_LIMIT, "listing").when(n > API_LIMIT, "api").alias("truncated"))


def surface_warnings(docs: DataFrame) -> DataFrame:
    """name and warning: fields that the API surface doesn't enforce, support files it can't hold, long descriptions."""
    size = F.length(F.coalesce("description", F.lit("")))
    tools = (F.coalesce("allowed_tools", F.lit("")) != "") | (F.coalesce("disallowed_tools", F.lit("")) != "") | F.coalesce("disable_model_invocation", F.lit(False))
    found = F.array_compact(F.array(F.when(tools, "tool fields aren't enforced"), F.when(F.regexp_count("body", F.lit(REFERENCE_FILE)) > 0, "support files aren't in the payload"), F.when(size > LISTING_LIMIT, "description is cut in listings"), F.when(size > API_LIMIT, "description is too long for the API")))
    return docs.select("name", F.explode(found).alias("warning"))


def api_payload(docs: DataFrame) -> DataFrame:
    return render(docs).join(docs.select("name", "description"), "name").select(F.to_json(F.struct(slug("name").alias("name"), F.col("name").alias("display_name"), "description", F.col("text").alias("content"))).alias("payload"))


def carried_lines(outputs: DataFrame) -> DataFrame:
    """name and line: the fields that each output (name, fields: a map) carries, in their fixed order, of metadata the keys alone."""
    value = lambda f: F.element_at("fields", F.lit(f))
    named = [F.when(F.trim(value(f)) != "", F.concat(F.lit(f"{f}: "), F.trim(value(f)))) for f in CARRIED if f != "metadata"]
    keys = F.array_join(F.array_sort(F.json_object_keys(value("metadata"))), ", ")
    line = F.array_join(F.array_compact(F.array(*named, F.when(keys != "", F.concat(F.lit("metadata: "), keys)))), "; ")
    return outputs.select("name", line.alias("line")).filter("line != ''")


def provenance(sources: DataFrame, layout: DataFrame, dropped: DataFrame, generated_at: str, outputs: DataFrame | None = None, findings: DataFrame | None = None, counts: dict[str, int] | None = None, warnings: list[str] = ()) -> str:
    """A report of sources (name, spdx_id, url), what each output is made of (cluster, atom_id), the frontmatter that outputs
    (name, fields) carry with what is to be reviewed of it (findings: severity, message), counts of what changed by name, drops by
    reason, and warnings. One short text: its rows are sums by source, output and reason."""
    lines = ["# Provenance", "", f"Generated {generated_at}.", "", "## Sources", ""]
    lines += [f"- **{r['name']}** ({r['spdx_id'] or 'license unknown'}), {r['url'] or 'local'}" for r in sources.orderBy("name").collect()]
    lines += ["", "## Composition", ""] + [f"- **{r['cluster']}**: atoms from {r['contributors']}" for r in contributors(layout).orderBy("cluster").collect()]
    carried = [f"- **{r['name']}**: {r['line']}" for r in carried_lines(outputs).orderBy("name").collect()] if outputs is not None else []
    carried += [f"- review: {r['message']}" for r in findings.filter("severity is not null").select("message").distinct().orderBy("message").collect()] if findings is not None else []
    if carried:
        lines += ["", "## Frontmatter carried", "", *carried]
    if counts:
        lines += ["", "## Changed", ""] + [f"- {k}: {v}" for k, v in counts.items()]
    reasons = drop_summary(dropped).orderBy("reason").collect()
    lines += ["", "## Dropped", "", ", ".join(f"{r['n']} {r['reason']}" for r in reasons) or "none"]
    if warnings:
        lines += ["", "## Warnings", "", *(f"- {w}" for w in warnings)]
    return "\n".join(lines) + "\n"


def api_envelope(docs: DataFrame, report: str, findings: DataFrame, bundles: DataFrame | None = None) -> dict:
    """What goes to the API for a few outputs: their payloads, the report with a note on sharing, whether the user must confirm (a
    finding of medium severity or more), and warnings."""
    confirm = not findings.filter("severity in ('medium', 'high', 'critical')").isEmpty()
    warnings = [SHARING_NOTE] + (["the frontmatter that was carried is to be reviewed; confirm before it is shared"] if confirm else [])
    warnings += [f"{r['name']}: {r['warning']}" for r in surface_warnings(docs).orderBy("name", "warning").collect()]
    if bundles is not None:
        warnings += [f"{r['name']}: {r['path']} isn't in the payload" for r in carried_support(docs, bundles).select("name", "path").orderBy("name", "path").collect()]
    skills = [json.loads(r["payload"]) for r in api_payload(docs).orderBy("payload").collect()]
    return {"surface": "api", "skills": skills, "provenance_md": f"{report}\n## Sharing\n\n{SHARING_NOTE}\n", "requires_confirmation": confirm, "warnings": warnings}


def set_name(outputs: DataFrame, router: DataFrame | None = None) -> str:
    """The router's name, else the first output's, else a name for all."""
    first = lambda df: df.filter("name is not null and name != ''").orderBy("name").select("name").first()
    found = (first(router) if router is not None else None) or first(outputs)
    return found["name"] if found else "composed-set"


def _rows(docs: DataFrame) -> list[tuple[str, str]]:
    """Rendered outputs: at most a few, by the limit on clusters."""
    _checked(docs)
    return [(r["name"], r["text"]) for r in render(docs).orderBy("name").collect()]


def tree_files(docs: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """path and content of every file of outputs: the rendered text of each, and the support files that its body names, if its
    bundle (name, path, content) has them."""
    texts = render(docs).select(F.concat("name", F.lit("/SKILL.md")).alias("path"), F.col("text").cast("binary").alias("content"))
    if bundles is None:
        return texts
    return texts.unionByName(carried_support(docs, bundles).select(F.concat_ws("/", "name", "path").alias("path"), "content"))


def _checked(docs: DataFrame) -> None:
    if (bare := [r[0] for r in blockers(docs).limit(5).collect()]):
        raise EmitError(f"no description: {', '.join(sorted(bare))}")


def write_tree(docs: DataFrame, out: str, report: str, set_name: str, bundles: DataFrame | None = None) -> list[str]:
    """Write outputs, their support files and the report below out, by tasks; the paths written, of at most a few outputs."""
    _checked(docs)
    reported = docs.sparkSession.createDataFrame([(f"PROVENANCE-{set_name}.md", bytearray(report.encode()))], "path string, content binary")
    files = tree_files(docs, bundles).unionByName(reported)
    write_files(files, out)
    return sorted(r["path"] for r in files.select("path").collect())


def default_plugin_name(outputs: DataFrame) -> str:
    """Names of the outputs (name) as one: the only one's, or all, in order, joined by dashes."""
    return "-".join(r["name"] for r in outputs.select("name").orderBy("name").collect()) or "skill"


def zip_bytes(docs: DataFrame, report: str, bundles: DataFrame | None = None) -> bytes:
    """An archive of at most a few outputs, their support files and the report. Equal outputs give equal bytes: fixed times,
    sorted names."""
    _checked(docs)
    files = {f"skills/{r['path']}": bytes(r["content"]) for r in tree_files(docs, bundles).collect()} | {"PROVENANCE.md": report.encode()}
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for path, data in sorted(files.items()):
            archive.writestr(zipfile.ZipInfo(path), data, zipfile.ZIP_DEFLATED)
    return held.getvalue()


def write_marketplace(docs: DataFrame, out: str, report: str, plugin: str, marketplace: str, owner: str) -> list[str]:
    if slug_like(marketplace) in RESERVED_MARKETPLACES:
        raise EmitError(f"{marketplace} is reserved")
    rows = _rows(docs)
    manifest = {"name": marketplace, "owner": {"name": owner}, "plugins": [{"name": plugin, "source": "./", "strict": False, "skills": [f"./skills/{n}" for n, _ in rows]}]}
    paths = {f"skills/{n}/SKILL.md": t for n, t in rows} | {"PROVENANCE.md": report, ".claude-plugin/marketplace.json": json.dumps(manifest, indent=2, sort_keys=True) + "\n"}
    for path, text in paths.items():
        (place := Path(out) / path).parent.mkdir(parents=True, exist_ok=True)
        place.write_text(text, encoding="utf-8")
    return sorted(paths)


def slug_like(name: str) -> str:
    return "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in name.lower()).split())


def dump_evals(queries: DataFrame) -> str:
    """Evaluation cases (query_id, text) by id, numbered from 1."""
    return json.dumps({"evals": [{"id": n, "prompt": r["text"]} for n, r in enumerate(queries.orderBy("query_id").collect(), 1)]}, indent=2, sort_keys=True) + "\n"
