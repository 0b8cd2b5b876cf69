"""Evaluation: structural quality, routing, trigger scores, leakage, edits, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.text import routing_tokens, tokenize
from corpusforge.operators.leakage import leaks, running_total

NAME_LIMIT, API_LIMIT, LISTING_LIMIT = 64, 1024, 1536
ROUTER = "orchestrator"
# Fixed values
RESERVED_NAME_WORDS = ["claude", "anthropic"]
FRONTMATTER_KEYS = ["name", "description", "license", "compatibility", "allowed-tools", "disallowed-tools", "disable-model-invocation", "metadata"]
STRONG = r"(?iU)\b(must|always|never|do not|don'?t|required|ensure|shall)\b"
WEAK = r"(?iU)\b(maybe|consider|try to|should probably|if possible|optionally|perhaps)\b"
CODE = r"(?s)```.*?```|`[^`]*`"
TAG = r"<[/!]?[a-zA-Z][^<>]*>"


def quality(docs: DataFrame) -> DataFrame:
    """Report of each document (name, description, body, keys array): counts, issues, warnings, passed."""
    description = F.coalesce("description", F.lit(""))
    strong, weak = F.regexp_count("body", F.lit(STRONG)), F.regexp_count("body", F.lit(WEAK))
    odd = F.array_sort(F.array_except("keys", F.array(*map(F.lit, FRONTMATTER_KEYS))))
    reserved = F.lit(False)
    for word in RESERVED_NAME_WORDS:
        reserved = reserved | F.lower("name").contains(word)
    size = F.length(description)
    issues = F.array_compact(
        F.array(
            F.when(F.length("name") > NAME_LIMIT, F.lit("name too long")),
            F.when(reserved, F.lit("name has a reserved word")),
            F.when(F.trim(description) == "", F.lit("description is empty")),
            F.when(size > LISTING_LIMIT, F.lit("description over the listing limit")),
            F.when(F.size(odd) > 0, F.concat(F.lit("unknown keys: "), F.array_join(odd, ", "))),
        )
    )
    warnings = F.array_compact(F.array(F.when((size > API_LIMIT) & (size <= LISTING_LIMIT), F.lit("description over the API limit")), F.when(F.regexp_replace("body", CODE, " ").rlike(TAG), F.lit("html-like tag"))))
    return docs.select(
        "name", F.length("name").alias("name_chars"), size.alias("description_chars"),
        F.regexp_count("body", F.lit("\n")).alias("body_lines"), strong.alias("strong_markers"), weak.alias("weak_markers"),
        F.bround(strong / (strong + weak + 1), 3).alias("marker_ratio"), issues.alias("issues"), warnings.alias("warnings"), (F.size(issues) == 0).alias("passed"),
    )


def route(queries: DataFrame, surfaces: DataFrame) -> DataFrame:
    """query_id and routed_skill of each query (query_id, text): the surface (name, description) whose matched tokens' idf sum
    is positive and strictly above every other; else null.

    A token in every one of several surfaces weighs nothing. Surfaces are the outputs of one merge, so their tokens are few;
    queries meet them in an equi-join on tokens.
    """
    total = surfaces.count()
    surface_tokens = surfaces.select("name", F.explode(routing_tokens(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))))).alias("token"))
    df = surface_tokens.groupBy("token").agg(F.count("*").alias("df"))
    idf = df.select("token", F.when((F.col("df") == total) & (F.lit(total) > 1), F.lit(0.0)).otherwise(F.log(1 + F.lit(float(total)) / F.col("df"))).alias("idf"))
    weighted = surface_tokens.join(idf, "token")
    tokens = queries.select("query_id", F.explode(routing_tokens("text")).alias("token"))
    # sums are rounded so that the order of addition can't part equal scores
    scores = tokens.join(F.broadcast(weighted), "token").groupBy("query_id", "name").agg(F.round(F.sum("idf"), 9).alias("score")).filter("score > 0")
    best = scores.groupBy("query_id").agg(F.max(F.struct("score", "name")).alias("top"), F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("two"))
    sure = best.select("query_id", F.when(F.get("two", F.lit(0)) > F.coalesce(F.get("two", F.lit(1)), F.lit(0.0)), F.col("top.name")).alias("routed_skill"))
    return queries.select("query_id").join(sure, "query_id", "left")


def split_queries(queries: DataFrame, held_out_fraction: float = 0.4) -> DataFrame:
    """queries (query_id, origin) with held_out: every second host query by id, from the first; source queries always train."""
    stride = max(2, round(1 / held_out_fraction)) if held_out_fraction > 0 else 0
    host = queries.filter("origin = 'host'").select("query_id").distinct()
    if not stride:
        held = host.withColumn("held_out", F.lit(False))
    else:
        ranges = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        held = running_total(host.withColumn("__one", F.lit(1)), ["query_id"], "__one", "__place", ranges).select("query_id", (F.col("__place") % stride == 0).alias("held_out"))
    return queries.join(held, "query_id", "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def judged(queries: DataFrame, judgments: DataFrame) -> DataFrame:
    """queries (query_id, kind, expected_skill, held_out) with ok; the last judgment (position) of a query counts."""
    last = judgments.groupBy("query_id").agg(F.max_by("routed_skill", "position").alias("routed_skill"))
    ok = F.when(F.col("kind") == "trigger", F.col("routed_skill").eqNullSafe(F.col("expected_skill"))).otherwise(F.col("routed_skill").isNull())
    return queries.join(last, "query_id", "left").withColumn("ok", ok)


def trigger_score(scored: DataFrame) -> DataFrame:
    """One row: total, pass rates in all, in training and held out, and the ids that failed."""
    rate = lambda of: F.coalesce(F.bround(F.try_divide(F.count_if(F.col("ok") & of), F.count_if(of)), 3), F.lit(0.0))
    return scored.agg(F.count("*").alias("total"), rate(F.lit(True)).alias("pass_rate"), rate(~F.col("held_out")).alias("train_pass_rate"), rate(F.col("held_out")).alias("held_out_pass_rate"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("query_id")))).alias("failed_ids"))


def disagreements(judgments: DataFrame, routed: DataFrame) -> DataFrame:
    """query_id where two routings differ."""
    other = routed.select("query_id", F.col("routed_skill").alias("independent"))
    return judgments.join(other, "query_id").filter(~F.col("routed_skill").eqNullSafe(F.col("independent"))).select("query_id")


def accept_edit(before: dict, after: dict, issues_before: DataFrame, issues_after: DataFrame, bodies_equal: bool, n_problems: int, n_leaks: int) -> dict:
    """Conservative gate: equal bodies, no problem, no leak, no new quality issue (skill, issue), and held-out rates not lower."""
    new = issues_after.select("skill", "issue").join(issues_before.select("skill", "issue"), ["skill", "issue"], "left_anti").count()
    reasons = [r for bad, r in ((not bodies_equal, "bodies differ"), (n_problems, "verifier problems"), (n_leaks, "leaks"), (new, "new quality issues"), (any(after[k] < before[k] for k in before), "held-out rate fell")) if bad]
    return {"accepted": not reasons, "reasons": reasons}


def changed_outputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """name of outputs (name, body) that only one version has, or whose bodies differ between the two."""
    sides = before.select("name", F.struct("body").alias("old")).join(after.select("name", F.struct("body").alias("new")), "name", "full")
    return sides.filter(~F.col("old").eqNullSafe(F.col("new"))).select("name")


def _corpus_of(outputs: DataFrame) -> DataFrame:
    """Bodies and descriptions of outputs (a few) as one ordered corpus, the router's at the end."""
    place = F.row_number().over(Window.orderBy(F.col("name") == ROUTER, "name"))
    parts = outputs.select(place.alias("n"), F.posexplode(F.array("body", "description")).alias("k", "text"))
    return parts.select((F.col("n") * 2 + F.col("k")).alias("doc"), "text")


def edit_description(surfaces: DataFrame, target: str, description: str, queries: DataFrame, baseline: DataFrame, candidate: DataFrame, n_problems: int = 0, router: DataFrame | None = None, edited: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """surfaces (name, description, and body, if at hand) with the new description of target if the edit is taken, else as they
    were, and the decision.

    target is an output's name, or "orchestrator" for the router (name, description, body), which comes back with the outputs if
    given; queries are routed to the outputs alone. edited is the version to judge, if another step made it, else the edit itself.
    queries: query_id, text, kind, expected_skill, origin. baseline and candidate: reported routings (query_id, routed_skill,
    position) before and after. Bodies must be what they were, no held-out query may stand in the corpus of bodies and
    descriptions, only quality issues that are new count, and held-out rates must not fall, neither by the reports nor by routing
    the queries to the descriptions themselves; an unknown target is refused.
    """
    whole = surfaces if "body" in surfaces.columns else surfaces.withColumn("body", F.lit(""))
    before_all = whole.select("name", "description", "body")
    if router is not None:
        before_all = before_all.unionByName(router.select(F.lit(ROUTER).alias("name"), "description", "body"))
    if before_all.filter(F.col("name") == target).isEmpty():
        return surfaces, {"accepted": False, "reasons": [f"no output is named {target}"]}
    after_all = before_all.withColumn("description", F.when(F.col("name") == target, F.lit(description)).otherwise(F.col("description"))) if edited is None else edited.select("name", "description", "body")
    split = split_queries(queries)

    def rate(judgments: DataFrame) -> float:
        return trigger_score(judged(split, judgments)).first()["held_out_pass_rate"]

    own = lambda s: route(queries, s.filter(F.col("name") != ROUTER)).withColumn("position", F.lit(0))
    before = {"reported": rate(baseline), "independent": rate(own(before_all))}
    after = {"reported": rate(candidate), "independent": rate(own(after_all))}
    issue = lambda s: quality(s.select("name", "description", "body", F.array().cast("array<string>").alias("keys"))).select(F.col("name").alias("skill"), F.explode("issues").alias("issue"))
    n_leaks = leaks(split.filter("held_out").select(F.col("query_id").alias("item_id"), "text"), _corpus_of(after_all)).count()
    decision = accept_edit(before, after, issue(before_all), issue(after_all), changed_outputs(before_all, after_all).isEmpty(), n_problems, n_leaks)
    taken = after_all if router is not None or edited is not None else after_all.select(*surfaces.columns)
    return (taken if decision["accepted"] else surfaces), decision | {"before": before["reported"], "after": after["reported"], "before_independent": before["independent"], "after_independent": after["independent"]}


def evaluation_passed(reports: DataFrame, n_problems: int, n_leaks: int) -> bool:
    """Quality of all children, no verifier problem, no leak; trigger scores don't enter."""
    return n_problems == 0 and n_leaks == 0 and reports.filter("not passed").isEmpty()


def history(decisions: DataFrame, by: str | None = None) -> DataFrame:
    """Ledger of decisions (n from 1, before, after, accepted), one for each value of `by`: a baseline v0, then one version for
    each decision.

    parent is the best version so far; the last accepted is the current best. A ledger is as long as one skill's history.
    """
    keys = [by] if by else []
    first = decisions.groupBy(*keys).agg(F.min_by("before", "n").alias("after"), F.count("*").alias("c")).filter("c > 0")
    first = first.select(*keys, F.lit(0).alias("n"), F.lit(None).cast("double").alias("before"), "after", F.lit(True).alias("accepted"))
    rows = first.unionByName(decisions.select(*keys, "n", "before", "after", "accepted"))
    whole = Window.partitionBy(*(keys or [F.lit(1)]))
    past = whole.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    version = F.concat(F.lit("v"), F.col("n").cast("string"))
    out = rows.withColumn("version", version).withColumn("parent", F.last(F.when(F.col("accepted"), version), ignorenulls=True).over(past))
    best = F.max(F.when(F.col("accepted"), F.col("n"))).over(whole)
    grade = F.when(F.col("n") == 0, "baseline").when(F.col("accepted"), "won").otherwise("lost")
    return out.select(*keys, "n", "version", "parent", F.col("after").alias("expectation_pass_rate"), grade.alias("grading_result"), (F.col("n") == best).alias("is_current_best"))


def cases_to_queries(cases: DataFrame) -> DataFrame:
    """Queries of evaluation cases (skill, position from 1, prompt): ids count all cases, blank prompts are left out."""
    return cases.filter(F.trim(F.coalesce("prompt", F.lit(""))) != "").select(F.format_string("src-%s-%d", "skill", "position").alias("query_id"), F.col("prompt").alias("text"), F.lit("trigger").alias("kind"), F.col("skill").alias("expected_skill"), F.lit("source").alias("origin"))


__all__ = ["accept_edit", "changed_outputs", "cases_to_queries", "disagreements", "edit_description", "evaluation_passed", "history", "judged", "leaks", "quality", "route", "split_queries", "tokenize", "trigger_score"]
