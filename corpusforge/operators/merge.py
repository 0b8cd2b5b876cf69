"""Merge of atoms: grouping, conflicts, reconciliation, pruning with closure, partition, assembly, verification.

Pairs are found by equi-joins on what they must share (a subject word, a bound's name, a key), never by a cross join. Where
very many atoms share one word, candidates are still only those of opposed polarity.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import relevance_tokens, slug, subject_words
from corpusforge.sources.tables import saved

# Patterns, separators and router texts must be these for outputs to be the same.
POSITIVE = r"(?iuU)\b(always|must|use|do|enable|require|prefer|ensure)\b"
NEGATIVE = r"(?iuU)\b(never|don'?t|do not|avoid|disable|forbid|must not|should not)\b"
NUMERIC = r"(?i)\b([a-z][a-z _-]{2,}?)\s*(?:[:=]|to|of|is|=|at)?\s*(\d+(?:\.\d+)?)\b"
IMPERATIVE = r"(?iuU)^\s*(?:[-*+]\s+|\d+[.)]\s+)?(?:always|never|do not|don'?t|must|should|ensure|make sure|avoid|use|run|call|prefer|keep|set|add|remove|check|validate|require|emit|return|write|read|include|exclude|apply|follow)\b"
TRIGGER = r"(?iuU)^\s*(?:when|if|use this (?:skill|when)|trigger)\b"
REFERENCE = r"(references|scripts|assets)/[\w./-]+|\b[\w-]+\.(?:json|ya?ml|md|csv)\b"

SEPARATOR = "\n"
ROUTER_OPENING = "# Orchestrator\n\nRoute each request to the matching skill.\n\n"


class GroupingError(ValueError):
    """Assignments that leave atoms out or name unknown ones."""


class ConflictError(ValueError):
    """An adjudicated winner that isn't one of the pair."""


class PruneError(ValueError):
    """A kept atom that depends on the loser of a conflict."""


def detected_kind(block: str | Column, text: str | Column) -> Column:
    block = F.col(block) if isinstance(block, str) else block
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.when(block == "heading", "heading").when(block.isin("fence", "code_block"), "example").when(text.rlike(TRIGGER), "trigger").when(text.rlike(IMPERATIVE), "directive").otherwise("context")


def default_grouping(atoms: DataFrame) -> DataFrame:
    return atoms.select(F.col("id").alias("atom_id"), F.col("skill").alias("group"), F.coalesce("detected_kind", F.lit("context")).alias("kind"))


def validate_grouping(atoms: DataFrame, assignments: DataFrame) -> DataFrame:
    """atom_id, group, kind and forced: complete, without unknown atoms; a detected directive stays one."""
    missing = atoms.join(assignments, atoms.id == assignments.atom_id, "left_anti").select("id")
    unknown = assignments.join(atoms, atoms.id == assignments.atom_id, "left_anti").select("atom_id")
    for what, found in (("without a group", missing), ("unknown", unknown)):
        if some := [r[0] for r in found.limit(5).collect()]:
            raise GroupingError(f"atoms {what}: {', '.join(some)}")
    joined = assignments.join(atoms.select(F.col("id").alias("atom_id"), "detected_kind"), "atom_id")
    forced = (F.col("detected_kind") == "directive") & (F.col("kind") != "directive")
    return joined.select("atom_id", "group", F.when(forced, "directive").otherwise(F.col("kind")).alias("kind"), F.coalesce(forced, F.lit(False)).alias("forced"))


def group_members(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("group").agg(F.sort_array(F.collect_list("atom_id")).alias("atom_ids"))


def _pairs(a: DataFrame, kind: str) -> DataFrame:
    return a.select(F.least("x", "y").alias("atom_a"), F.greatest("x", "y").alias("atom_b"), F.lit(kind).alias("type")).distinct()


def polarity_conflicts(directives: DataFrame) -> DataFrame:
    """Pairs of directives (id, text) of opposed polarity that share a subject word."""
    marked = directives.select("id", F.col("text").rlike(POSITIVE).alias("pos"), F.col("text").rlike(NEGATIVE).alias("neg"), F.explode(subject_words("text")).alias("word"))
    a = marked.filter("pos").select(F.col("id").alias("x"), "word")
    b = marked.filter("neg").select(F.col("id").alias("y"), "word")
    return _pairs(a.join(b, "word").filter("x != y"), "antonymic-directive")


def polarity_words(directives: DataFrame) -> DataFrame:
    """word, n_positive, n_negative, first_positive and first_negative of each subject word over which directives (id, text) are
    opposed. A word that very many share makes one row here, where `polarity_conflicts` gives every pair; sums are made before
    rows are shuffled."""
    marked = directives.select("id", F.col("text").rlike(POSITIVE).alias("pos"), F.col("text").rlike(NEGATIVE).alias("neg"), F.explode(subject_words("text")).alias("word")).filter("pos or neg")
    sides = marked.groupBy("word").agg(
        F.count_if("pos").alias("n_positive"), F.count_if("neg").alias("n_negative"), F.count_if(F.col("pos") & F.col("neg")).alias("n_both"),
        F.min(F.when(F.col("pos"), F.col("id"))).alias("first_positive"), F.min(F.when(F.col("neg"), F.col("id"))).alias("first_negative"),
    )
    # one directive that says both isn't opposed to itself
    return sides.filter("n_positive > 0 and n_negative > 0 and not (n_positive = 1 and n_negative = 1 and n_both = 1)").drop("n_both")


def numeric_bounds(text: str | Column) -> Column:
    """(key, value) of each bound a text states; the last value of a key counts."""
    text = F.col(text) if isinstance(text, str) else text
    keys = F.transform(F.regexp_extract_all(text, F.lit(NUMERIC), 1), lambda k: F.lower(F.trim(k)))
    values = F.transform(F.regexp_extract_all(text, F.lit(NUMERIC), 2), lambda v: v.cast("double"))
    return F.arrays_zip(keys.alias("key"), values.alias("value"))


def numeric_conflicts(directives: DataFrame) -> DataFrame:
    """Pairs that give one key different values."""
    stated = directives.select("id", F.posexplode(numeric_bounds("text")).alias("place", "bound")).select("id", "place", F.col("bound.key").alias("key"), F.col("bound.value").alias("value"))
    last = stated.groupBy("id", "key").agg(F.max_by("value", "place").alias("value"))
    a = last.select(F.col("id").alias("x"), "key", F.col("value").alias("vx"))
    b = last.select(F.col("id").alias("y"), "key", F.col("value").alias("vy"))
    return _pairs(a.join(b, "key").filter("x < y and vx != vy"), "numeric-bound")


def trigger_conflicts(triggers: DataFrame) -> DataFrame:
    """Pairs of triggers (id, skill, norm_key) with one key in different skills."""
    a = triggers.select(F.col("id").alias("x"), F.col("skill").alias("sx"), "norm_key")
    b = triggers.select(F.col("id").alias("y"), F.col("skill").alias("sy"), "norm_key")
    return _pairs(a.join(b, "norm_key").filter("x < y and sx != sy"), "same-trigger")


def detect_structural(atoms: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """atom_a, atom_b, type and source of conflicts among atoms; kinds (atom_id, kind) override the detected ones."""
    kind = F.col("detected_kind")
    if kinds is not None:
        atoms = atoms.join(kinds.select(F.col("atom_id").alias("id"), F.col("kind").alias("given_kind")), "id", "left")
        kind = F.coalesce("given_kind", "detected_kind")
    directives, triggers = atoms.filter(kind == "directive"), atoms.filter(kind == "trigger")
    found = polarity_conflicts(directives).union(numeric_conflicts(directives)).union(trigger_conflicts(triggers))
    return found.withColumn("source", F.lit("structural"))


def adjudicate(structural: DataFrame, rulings: DataFrame) -> DataFrame:
    """Structural conflicts with the severity and winner of the last ruling (position, atom_a, atom_b, type, severity,
    winner) on the pair; rulings on other pairs are added as semantic conflicts."""
    last = rulings.select("position", F.least("atom_a", "atom_b").alias("atom_a"), F.greatest("atom_a", "atom_b").alias("atom_b"), F.col("type").alias("ruled_type"), "severity", "winner")
    last = last.groupBy("atom_a", "atom_b").agg(F.max_by(F.struct("ruled_type", "severity", "winner"), "position").alias("r"))
    joined = structural.join(last, ["atom_a", "atom_b"], "left")
    if (bad := joined.filter("r.winner is not null and r.winner not in (atom_a, atom_b)").select("r.winner").first()) is not None:
        raise ConflictError(f"{bad[0]} isn't one of the pair")
    ruled = joined.select("atom_a", "atom_b", "type", "source", F.col("r.severity").alias("severity"), F.col("r.winner").alias("winner"))
    more = last.join(structural, ["atom_a", "atom_b"], "left_anti").select("atom_a", "atom_b", F.coalesce("r.ruled_type", F.lit("semantic")).alias("type"), F.lit("semantic").alias("source"), F.col("r.severity").alias("severity"), F.col("r.winner").alias("winner"))
    return ruled.unionByName(more)


def reconcile_conflicts(conflicts: DataFrame, atoms: DataFrame, source_rank: DataFrame | None = None) -> DataFrame:
    """conflicts with outcome (resolved or unresolved), kept and loser.

    The atom of the lower severity rank wins; else the ruling's winner; else the better of (source rank, longer text,
    earlier place). Equal atoms, and pairs with an unknown atom, stay unresolved. atoms: id, skill, text, source_order, max_severity.
    """
    rank = F.element_at(F.create_map(*map(F.lit, ["info", 0, "low", 1, "medium", 2, "high", 3, "critical", 4])), F.col("max_severity"))
    known = atoms.withColumn("sev", F.coalesce(rank, F.lit(0)))
    known = known.withColumn("srank", F.lit(99)) if source_rank is None else known.join(source_rank.select("skill", F.col("rank").alias("given")), "skill", "left").withColumn("srank", F.coalesce("given", F.lit(99)))
    key = F.struct("srank", (-F.length("text")).alias("len"), "source_order")
    side = lambda n: known.select(F.col("id").alias(f"atom_{n}"), F.col("sev").alias(f"sev_{n}"), key.alias(f"key_{n}"))
    joined = conflicts.join(side("a"), "atom_a", "left").join(side("b"), "atom_b", "left")
    both = F.col("key_a").isNotNull() & F.col("key_b").isNotNull()
    kept = (
        F.when(~both, F.lit(None))
        .when(F.col("sev_a") < F.col("sev_b"), F.col("atom_a"))
        .when(F.col("sev_b") < F.col("sev_a"), F.col("atom_b"))
        .when(F.col("winner").isNotNull(), F.col("winner"))
        .when(F.col("key_a") < F.col("key_b"), F.col("atom_a"))
        .when(F.col("key_b") < F.col("key_a"), F.col("atom_b"))
    )
    out = joined.withColumn("kept", kept).withColumn("loser", F.when(F.col("kept").isNotNull(), F.when(F.col("kept") == F.col("atom_a"), F.col("atom_b")).otherwise(F.col("atom_a"))))
    return out.withColumn("outcome", F.when(F.col("kept").isNotNull(), "resolved").otherwise("unresolved")).select("atom_a", "atom_b", "type", "outcome", "kept", "loser")


def build_edges(atoms: DataFrame) -> DataFrame:
    """Resource edges of dependency references: the folder that a path in the text opens with; bare file names give none."""
    refs = atoms.filter(F.coalesce("kind", "detected_kind") == "dependency-ref")
    return refs.select(F.col("id").alias("src_atom_id"), F.explode(F.regexp_extract_all("text", F.lit(REFERENCE), 1)).alias("target_ref")).filter("target_ref != ''").withColumn("kind", F.lit("resource"))


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that lead on from start (id) over edges (src, dst), start included; ends on cycles.

    The frontier alone is joined at each step. Frontiers are written tables, so that a step's plan doesn't hold those before.
    """
    frontier = seen = saved(start.select("id").distinct(), "frontier")
    edges = saved(edges.select("src", "dst").distinct(), "edges")
    while True:
        frontier = saved(frontier.join(edges, frontier.id == edges.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def prune_and_close(atoms: DataFrame, needles: list[str], edges: DataFrame, losers: DataFrame) -> DataFrame:
    """id, status (kept or dropped) and reason: relevant atoms that didn't lose, and what they depend on.

    edges: src_atom_id, target_ref, resolved_atom_id, kind. Reaching a loser is an error.
    """
    lost = losers.select("id").distinct()
    hit = F.lit(True) if not needles else F.arrays_overlap(relevance_tokens("text"), F.array(*map(F.lit, needles)))
    relevant = atoms.filter(hit).select("id").join(lost, "id", "left_anti")
    known = atoms.select(F.col("id").alias("dst"))
    links = edges.filter("kind = 'atom'").select(F.col("src_atom_id").alias("src"), F.col("resolved_atom_id").alias("dst")).join(known, "dst", "left_semi").select("src", "dst")
    kept = reachable(relevant, links)
    if (bad := kept.join(lost, "id", "left_semi").first()) is not None:
        raise PruneError(f"a kept atom depends on {bad[0]}, which lost a conflict")
    marked = atoms.select("id").join(kept.withColumn("kept", F.lit(True)), "id", "left").join(lost.withColumn("lost", F.lit(True)), "id", "left")
    return marked.select("id", F.when(F.col("kept"), "kept").otherwise("dropped").alias("status"), F.when(F.col("kept").isNull(), F.when(F.col("lost"), "conflict-loser").otherwise("out-of-scope")).alias("reason"))


def merge_groups(sizes: dict[str, int], apart: set[tuple[str, str]], limit: int) -> tuple[dict[str, list[str]], list[str]]:
    """Labels of clusters with their groups, and the labels of those that nothing may join: always the first pair by (size,
    label) that no conflict keeps apart is merged, until `limit` are left or no pair is free.

    A heap has the clusters in order, and each knows those that it conflicts with; a merged cluster takes over both sets. The
    smallest cluster looks past no more clusters than it conflicts with. One that conflicts with every other does so with all
    that they merge into as well, and is put aside for good. So n groups with m conflicts take about (n + m) log n steps.
    """
    members, size, label, heap = {}, {}, {}, []
    number = {g: i for i, g in enumerate(sorted(sizes))}
    against: dict[int, set[int]] = {i: set() for i in number.values()}
    for g, i in number.items():
        members[i], size[i], label[i] = [g], sizes[g], g
        heap.append((sizes[g], g, i))
    for a, b in apart:
        if a != b and a in number and b in number:
            against[number[a]].add(number[b])
            against[number[b]].add(number[a])
    heapq.heapify(heap)
    stuck: list[int] = []
    fresh = len(number)
    while len(heap) + len(stuck) > limit and len(heap) > 1:
        first = heapq.heappop(heap)
        x = first[2]
        if len(against[x]) - len(stuck) == len(heap):
            stuck.append(x)
            continue
        passed = []
        while (other := heapq.heappop(heap))[2] in against[x]:
            passed.append(other)
        y = other[2]
        for item in passed:
            heapq.heappush(heap, item)
        small, large = sorted((x, y), key=lambda i: len(against[i]))
        for z in against[small]:
            against[z].discard(small)
            against[z].add(fresh)
        for z in against[large]:
            against[z].discard(large)
            against[z].add(fresh)
        against[large] |= against[small]
        against[fresh] = against[large]
        members[fresh], size[fresh], label[fresh] = members.pop(x) + members.pop(y), size[x] + size[y], " + ".join(sorted({label[x], label[y]}))
        heapq.heappush(heap, (size[fresh], label[fresh], fresh))
        fresh += 1
    left = stuck + [item[2] for item in heap]
    return {label[i]: sorted(members[i]) for i in left}, sorted(label[i] for i in stuck)


def partition(kept: DataFrame, groups: DataFrame, conflicts: DataFrame, limit: int = 3) -> tuple[DataFrame, list[str]]:
    """cluster and atom_id, and warnings: groups (atom_id, group) merged until at most `limit` are left.

    Sizes of groups and pairs of groups in conflict are summed up by Spark; only these reach the driver, where labels are merged.
    A conflict within one group keeps nothing apart.
    """
    members = kept.select(F.col("id").alias("atom_id")).join(groups.select("atom_id", "group"), "atom_id")
    sizes = {r["group"]: r["n"] for r in members.groupBy("group").agg(F.count("*").alias("n")).collect()}
    a = members.select(F.col("atom_id").alias("atom_a"), F.col("group").alias("ga"))
    b = members.select(F.col("atom_id").alias("atom_b"), F.col("group").alias("gb"))
    between = conflicts.select("atom_a", "atom_b").join(a, "atom_a").join(b, "atom_b").filter("ga != gb")
    apart = {(r["x"], r["y"]) for r in between.select(F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y")).distinct().collect()}
    clusters, _ = merge_groups(sizes, apart, limit)
    warnings = [f"{len(clusters)} clusters are left: merging more would put conflicting atoms together"] if len(clusters) > limit else []
    spark = kept.sparkSession
    labels = list(clusters)
    numbers = spark.createDataFrame([(g, i) for i, label in enumerate(labels) for g in clusters[label]], "group string, n int")
    names = spark.createDataFrame(list(enumerate(labels)), "n int, cluster string")  # long labels go to each cluster once, not to each group
    return members.join(numbers, "group").join(names, "n").select("cluster", "atom_id"), warnings


def layout(clusters: DataFrame, atoms: DataFrame) -> DataFrame:
    """cluster, position and atom_id of each source atom, by skill, order and id."""
    from corpusforge.operators.dedupe import order_in

    joined = clusters.join(atoms.select(F.col("id").alias("atom_id"), "skill", "source_order", "text"), "atom_id")
    return order_in(joined, ["cluster"], ["skill", "source_order", "atom_id"])


def contributors(placed: DataFrame) -> DataFrame:
    """cluster and the sources, by name, that its atoms (atom_id: source:path:hash) come from."""
    source = F.split_part("atom_id", F.lit(":"), F.lit(1))
    return placed.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_set(source)), ", ").alias("contributors"))


def drop_summary(dropped: DataFrame) -> DataFrame:
    """reason and n of dropped atoms (id, reason)."""
    return dropped.groupBy("reason").agg(F.count("*").alias("n"))


def assemble(placed: DataFrame) -> DataFrame:
    """cluster, name and body of each output: its atoms' texts in order, a line end between them."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    return placed.groupBy("cluster").agg(F.array_join(F.transform(ordered, lambda x: x.text), SEPARATOR).alias("body")).withColumn("name", slug("cluster")).select("cluster", "name", "body")


def route_line(label: Column, name: Column) -> Column:
    return F.concat(F.lit("- When the task involves "), label, F.lit(", use the "), name, F.lit(" skill.\n"))


def router(outputs: DataFrame) -> DataFrame:
    """The routing output where there is more than one other: its description and body from fixed templates."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("cluster").alias("label"), F.col("name").alias("name"))))
    body = F.concat(F.lit(ROUTER_OPENING), F.array_join(F.transform("routes", lambda r: route_line(r.label, r["name"])), ""))
    text = F.concat(F.lit("Coordinates a set of related skills and routes each request to the matching one. Use when a task may involve: "), F.array_join(F.transform("routes", lambda r: r.label), ", "), F.lit("."))
    return outputs.groupBy().agg(ordered.alias("routes")).filter(F.size("routes") > 1).select(F.lit("orchestrator").alias("name"), text.alias("description"), body.alias("body"))


def verify(outputs: DataFrame, placed: DataFrame, atoms: DataFrame, dropped: DataFrame) -> DataFrame:
    """problem and item; no row means that every byte of every output comes from a known atom.

    outputs: cluster, body. placed: cluster, position, atom_id. atoms: id, skill, source_order, text. dropped: id, reason.
    """
    unknown = placed.join(atoms, placed.atom_id == atoms.id, "left_anti").select(F.lit("unknown atom").alias("problem"), F.col("atom_id").alias("item"))
    texts = placed.select("cluster", "position", "atom_id").join(atoms.select(F.col("id").alias("atom_id"), "text"), "atom_id")
    again = assemble(texts).select("cluster", F.col("body").alias("expected"))
    changed = outputs.join(again, "cluster", "left").filter(~F.col("body").eqNullSafe(F.col("expected"))).select(F.lit("body differs from its atoms"), "cluster")
    twice = placed.groupBy("atom_id").count().filter("count > 1").select(F.lit("atom in more than one place"), "atom_id")
    silent = dropped.filter("reason is null or reason = ''").select(F.lit("dropped without a reason"), "id")
    return unknown.union(changed).union(twice).union(silent)
