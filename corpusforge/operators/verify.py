"""Proof that outputs hold nothing but their sources: layouts, bodies, router, drops and frontmatter, each checked for itself.

Nothing that the merge handed down is trusted: atoms come from sources parsed again, frontmatter is reconciled again. No body is
gathered: bodies and the texts that should make them are cut at the same bytes, and equal places are compared in one join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.operators.merge import ROUTER_OPENING, SEPARATOR, route_line
from corpusforge.sources.frontmatter import CARRIED
from corpusforge.sources.tables import saved

SEPARATOR_SLOT, OPENING_SLOT, ROUTE_SLOT = "sep", "orch-intro", "route"
#: Bytes in a chunk of a body, and slots in a block of a layout.
CHUNK, BLOCK = 4096, 4096


def slots(placed: DataFrame) -> DataFrame:
    """cluster, position, role, atom_id and template_id of every slot of outputs whose atoms are placed (cluster, position from
    1, atom_id): atoms with a separator between each two."""
    atoms = placed.select("cluster", (2 * F.col("position") - 2).alias("position"), F.lit("source").alias("role"), "atom_id", F.lit(None).cast("string").alias("template_id"))
    between = placed.filter("position > 1").select("cluster", (2 * F.col("position") - 3).alias("position"), F.lit("scaffold").alias("role"), F.lit("").alias("atom_id"), F.lit(SEPARATOR_SLOT).alias("template_id"))
    return atoms.unionByName(between)


def _problems(rows: DataFrame, problem: str, cluster: Column, item: Column) -> DataFrame:
    return rows.select(F.lit(problem).alias("problem"), cluster.cast("string").alias("cluster"), item.cast("string").alias("item"))


def unknown_slots(layout: DataFrame, atoms: DataFrame) -> DataFrame:
    """Atoms that no source has, and scaffolds that aren't separators."""
    known = atoms.select(F.col("id").alias("atom_id")).distinct()
    strange = layout.filter("role = 'source'").join(known, "atom_id", "left_anti")
    odd = layout.filter((F.col("role") != "source") & ~F.col("template_id").eqNullSafe(SEPARATOR_SLOT))
    return _problems(strange, "unknown atom", F.col("cluster"), F.col("atom_id")).union(_problems(odd, "unknown scaffold", F.col("cluster"), F.coalesce("template_id", F.lit(""))))


def _starts(parts: DataFrame) -> DataFrame:
    """parts (cluster, position, raw) with the byte that each starts at.

    Lengths are summed by blocks of positions first, so that no window holds a whole body's slots."""
    blocked = parts.withColumns({"n": F.octet_length("raw").cast("long"), "block": F.floor(F.col("position") / BLOCK)})
    sums = blocked.groupBy("cluster", "block").agg(F.sum("n").alias("in_block"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("cluster", "block", F.coalesce(F.sum("in_block").over(before("cluster").orderBy("block")), F.lit(0)).alias("base"))
    inside = blocked.withColumn("inside", F.coalesce(F.sum("n").over(before("cluster", "block").orderBy("position")), F.lit(0)))
    return inside.join(bases, ["cluster", "block"]).select("cluster", "raw", "n", (F.col("base") + F.col("inside")).alias("start"))


def changed_bodies(outputs: DataFrame, layout: DataFrame, atoms: DataFrame) -> DataFrame:
    """cluster of each output (cluster, body) whose body isn't its slots' texts, byte for byte. Only whole layouts can be
    judged: those with an unknown slot are left out."""
    texts = atoms.select(F.col("id").alias("atom_id"), F.col("text").cast("binary").alias("own")).dropDuplicates(["atom_id"])
    made = F.when(F.col("role") == "source", F.col("own")).when(F.col("template_id") == SEPARATOR_SLOT, F.lit(SEPARATOR).cast("binary"))
    parts = saved(layout.join(texts, "atom_id", "left").select("cluster", "position", made.alias("raw")), "slots")
    broken = parts.filter("raw is null").select("cluster").distinct()
    whole = _starts(parts.join(broken, "cluster", "left_anti"))
    n = F.col("n")
    cut = whole.filter("n > 0").select("*", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.col("start") + n - 1) / CHUNK))).alias("chunk"))
    low = F.greatest(F.col("start"), F.col("chunk") * CHUNK)
    high = F.least(F.col("start") + n, (F.col("chunk") + 1) * CHUNK)
    pieces = cut.select("cluster", "chunk", low.alias("at"), F.substring("raw", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    # a chunk has at most CHUNK pieces
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "piece"))), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x.piece))
    expected = pieces.groupBy("cluster", "chunk").agg(joined.alias("expected"))
    body = F.col("body").cast("binary")
    length = F.octet_length("body")
    judged = outputs.join(broken, "cluster", "left_anti")
    chunks = judged.filter(length > 0).select("cluster", body.alias("raw"), F.explode(F.sequence(F.lit(0), F.floor((length - 1) / CHUNK))).alias("chunk"))
    found = chunks.select("cluster", "chunk", F.substring("raw", (F.col("chunk") * CHUNK + 1).cast("int"), CHUNK).alias("found"))
    differ = expected.join(found, ["cluster", "chunk"], "full").filter(~F.col("expected").eqNullSafe(F.col("found")))
    return differ.select("cluster").join(judged.select("cluster"), "cluster", "left_semi").distinct()


def router_problems(outputs: DataFrame, router: DataFrame, router_slots: DataFrame, routes: DataFrame) -> DataFrame:
    """A router stands if and only if there is more than one output, holds known scaffolds alone, and says what the table of
    routes (position, label, skill_name) gives. Outputs of one merge are few, so a router is one short row."""
    counts = outputs.agg((F.count("*") > 1).alias("wanted")).crossJoin(router.agg((F.count("*") > 0).alias("there")))  # one row each
    missing = _problems(counts.filter("wanted and not there"), "router missing", F.lit("orchestrator"), F.lit(""))
    extra = _problems(counts.filter("there and not wanted"), "router for one output", F.lit("orchestrator"), F.lit(""))
    odd = router_slots.filter((F.col("role") == "scaffold") & ~F.coalesce(F.col("template_id").isin(OPENING_SLOT, ROUTE_SLOT), F.lit(False)))
    table = routes.agg(F.array_sort(F.collect_list(F.struct("position", "label", "skill_name"))).alias("rows"))
    text = F.concat(F.lit(ROUTER_OPENING), F.array_join(F.transform("rows", lambda r: route_line(r.label, r.skill_name)), ""))
    changed = router.crossJoin(table).filter(~F.col("body").eqNullSafe(text))  # one row each
    return reduce(DataFrame.union, [missing, extra, _problems(odd, "unknown scaffold", F.lit("orchestrator"), F.coalesce("template_id", F.lit(""))), _problems(changed, "router differs from its routes", F.lit("orchestrator"), F.lit(""))])


def frontmatter_problems(outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """Carried fields of outputs (cluster, fields: a map of field and value) that no source gives, or not so.

    expected: cluster, field, value, reconciled again from the sources. A field that is left out isn't a problem.
    """
    given = outputs.select("cluster", F.explode("fields").alias("field", "given"))
    both = given.filter(F.col("field").isin(CARRIED)).join(expected.select("cluster", "field", "value"), ["cluster", "field"], "left").filter(~F.col("given").eqNullSafe(F.col("value")))
    return both.select(F.when(F.col("value").isNull(), "frontmatter without a source").otherwise("frontmatter differs from its sources").alias("problem"), F.col("cluster").cast("string").alias("cluster"), F.col("field").alias("item"))


def verify_all(outputs: DataFrame, layout: DataFrame, atoms: DataFrame, dropped: DataFrame, router: DataFrame, router_slots: DataFrame, routes: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """problem, cluster and item; no row means that the outputs are proven.

    outputs: cluster, body, fields. layout: cluster, position, role, atom_id, template_id. atoms: id, text, parsed again. dropped:
    id, reason. router: body. router_slots: role, template_id. routes: position, label, skill_name. expected: as for
    `frontmatter_problems`; without it, no field is justified.
    """
    placed = layout.filter("role = 'source'").groupBy("atom_id").agg(F.count("*").alias("n")).filter("n > 1")
    nothing = F.lit(None)
    found = [
        unknown_slots(layout, atoms),
        _problems(changed_bodies(outputs, layout, atoms), "body differs from its atoms", F.col("cluster"), F.lit("")),
        router_problems(outputs, router, router_slots, routes),
        _problems(placed, "atom in more than one place", nothing, F.col("atom_id")),
        _problems(dropped.filter("reason is null or reason = ''"), "dropped without a reason", nothing, F.col("id")),
    ]
    if "fields" in outputs.columns:
        none = outputs.sparkSession.createDataFrame([], "cluster string, field string, value string")
        found.append(frontmatter_problems(outputs, none if expected is None else expected))
    return reduce(DataFrame.union, found)
