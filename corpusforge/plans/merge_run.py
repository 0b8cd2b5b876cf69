"""The whole merge, from documents to verified outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.operators import dedupe, merge, verify
from corpusforge.sources import frontmatter
from corpusforge.sources.markdown import parse_atoms
from corpusforge.sources.tables import saved


@dataclass
class MergeRun:
    atoms: DataFrame
    outputs: DataFrame
    router: DataFrame
    layout: DataFrame
    dropped: DataFrame
    conflicts: DataFrame
    warnings: list[str]
    problems: DataFrame
    findings: DataFrame


def run_merge(docs: DataFrame, needles: list[str], grouping: DataFrame | None = None, rulings: DataFrame | None = None, limit: int = 3) -> MergeRun:
    """docs: skill, body, and frontmatter (JSON text), if any. Parse, collapse, group, find and settle conflicts, prune,
    partition, assemble, carry frontmatter, verify."""
    spark = docs.sparkSession
    parsed = saved(parse_atoms(docs), "atoms")
    atoms = dedupe.survivors(dedupe.collapse(parsed)).drop("survivor").withColumn("max_severity", F.lit(None).cast("string")).withColumn("kind", F.lit(None).cast("string"))
    assigned = merge.validate_grouping(atoms, merge.default_grouping(atoms) if grouping is None else grouping)
    conflicts = merge.detect_structural(atoms, assigned)
    empty = spark.createDataFrame([], "position int, atom_a string, atom_b string, type string, severity string, winner string")
    settled = saved(merge.reconcile_conflicts(merge.adjudicate(conflicts, empty if rulings is None else rulings), atoms), "settled")
    losers = settled.filter("loser is not null").select(F.col("loser").alias("id"))
    edges = merge.build_edges(atoms).withColumn("resolved_atom_id", F.lit(None).cast("string"))
    pruned = saved(merge.prune_and_close(atoms, needles, edges, losers), "pruned")
    kept = pruned.filter("status = 'kept'").select("id")
    clusters, warnings = merge.partition(kept, assigned, settled.filter("outcome = 'unresolved'"), limit)
    layout = saved(merge.layout(clusters, atoms), "layout")
    dropped = pruned.filter("status = 'dropped'").select("id", "reason")
    if "frontmatter" not in docs.columns:
        docs = docs.withColumn("frontmatter", F.lit("{}"))
    sources = docs.select("skill", F.row_number().over(Window.orderBy("skill")).alias("source_order"), "frontmatter")  # a few chosen sources
    drawn_on = frontmatter.contributing_sources(layout.select("cluster", "atom_id"), parsed)
    carried = saved(frontmatter.carried_fields(drawn_on, sources), "carried")
    fields = carried.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    outputs = saved(merge.assemble(layout).join(fields, "cluster", "left"), "outputs").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    router = merge.router(outputs)
    routes = outputs.select(F.row_number().over(Window.orderBy("cluster")).alias("position"), F.col("cluster").alias("label"), F.col("name").alias("skill_name"))  # at most `limit`, or as many as conflicts keep apart
    slots = router.select(F.explode(F.array(F.lit(verify.OPENING_SLOT), F.lit(verify.ROUTE_SLOT))).alias("template_id")).select(F.lit("scaffold").alias("role"), "template_id")
    problems = verify.verify_all(outputs, verify.slots(layout), parsed, dropped, router, slots, routes, frontmatter.carried_fields(drawn_on, sources))
    return MergeRun(atoms, outputs, router, layout, dropped, settled, warnings, problems, frontmatter.carry_findings(drawn_on, sources))
