"""Ranking of catalog entries against a profile, and selection from the ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import clean, tokenize
from corpusforge.sources.tables import saved

# The weight of a needle by its label.
WEIGHTS = {"language": 3.0, "framework": 2.0, "convention": 1.0, "task": 1.0, "term": 0.5}


class SelectionError(ValueError):
    """A choice that can't be taken as it is."""


def profile_needles(profile: DataFrame) -> DataFrame:
    """label, weight and needle of a profile (summary, languages, frameworks, conventions, tasks); each once for its label."""
    listed = lambda c: F.filter(F.transform(c, clean), lambda x: x != "")
    labelled = F.array(
        *[F.struct(F.lit(label).alias("label"), F.lit(WEIGHTS[label]).alias("weight"), needles.alias("needles"))
          for label, needles in (
              ("language", listed("languages")), ("framework", listed("frameworks")), ("convention", listed("conventions")),
              ("task", F.flatten(F.transform("tasks", tokenize))), ("term", tokenize("summary")))]
    )
    return profile.select(F.explode(labelled).alias("x")).select("x.label", "x.weight", F.explode("x.needles").alias("needle")).distinct()


def entry_tokens() -> Column:
    """The tokens of an entry: its languages and tags as they are, and the tokens of its name and description."""
    both = F.filter(F.transform(F.concat("languages", "tags"), clean), lambda x: x != "")
    return F.array_union(both, tokenize(F.concat_ws(" ", "name", "description")))


def with_met(catalog: DataFrame, needles: DataFrame, *keep: str) -> DataFrame:
    """Entries with the columns in keep and `met`: the needles that stand in the entry, themselves or every token of them; entries
    with none are left out.

    The needles of one profile, a short list, become a constant; each entry is tokenised once and its tokens are met with that
    list in place, so nothing is shuffled and no other token is kept.
    """
    rows = needles.select("needle", tokenize("needle").alias("parts")).distinct().collect()
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    wanted = texts(sorted({x for r in rows for x in (r["needle"], *r["parts"])}))
    listed = F.array(*[F.struct(F.lit(r["needle"]).alias("needle"), texts(r["parts"]).alias("parts")) for r in rows]) if rows else F.array().cast("array<struct<needle: string, parts: array<string>>>")
    # exploded, an array of one, so that no condition or expression above makes the tokens again
    found = catalog.select(*keep, F.explode(F.array(F.array_intersect(entry_tokens(), wanted))).alias("found")).filter(F.size("found") > 0)
    met = F.filter(listed, lambda x: F.array_contains(F.col("found"), x.needle) | ((F.size(x.parts) > 0) & (F.size(F.array_except(x.parts, F.col("found"))) == 0)))
    return found.select(*keep, F.transform(met, lambda x: x.needle).alias("met")).filter(F.size("met") > 0)


def hits(catalog: DataFrame, needles: DataFrame) -> DataFrame:
    """id and needle where the needle, or every token of it, stands in the entry."""
    return with_met(catalog, needles, "id").select("id", F.explode("met").alias("needle")).distinct()


def needle_idf(found: DataFrame, n_entries: int) -> DataFrame:
    """needle and idf = ln(1 + N / df); N counts every entry, blocked ones too."""
    return found.groupBy("needle").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + F.lit(float(n_entries)) / F.col("df")))


def discover(catalog: DataFrame, profile: DataFrame, blocked: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """The best entries by the sum of weight times idf over matched needles, with the evidence.

    catalog: id, name, description, languages, tags, stars, bundle_hash. blocked: bundle_hash. Entries without a match don't
    show. Order: score, stars (null last), lower-cased name, id. The profile is one description: its needles with what each is worth
    become a constant, and entries are scored in place.
    """
    needles = profile_needles(profile)
    keep = [c for c in ("id", "name", "stars", "bundle_hash") if c in catalog.columns]
    found = saved(with_met(catalog, needles, *keep), "hits")  # the only pass over descriptions
    idf = {r["needle"]: r["idf"] for r in needle_idf(found.select(F.explode("met").alias("needle")), catalog.count()).collect()}  # a row for each needle at most
    weighed = [F.struct(F.lit(r["label"]).alias("label"), F.lit(r["needle"]).alias("needle"), F.lit(r["weight"] * idf[r["needle"]]).alias("worth")) for r in needles.orderBy("label", "needle").collect() if r["needle"] in idf]
    listed = F.array(*weighed) if weighed else F.array().cast("array<struct<label: string, needle: string, worth: double>>")
    open_ = found if blocked is None else found.join(blocked.select("bundle_hash").filter("bundle_hash != ''").distinct(), "bundle_hash", "left_anti")
    ranked = open_.withColumn("hit", F.filter(listed, lambda x: F.array_contains("met", x.needle))).select(
        "id", "name", "stars", F.bround(F.aggregate("hit", F.lit(0.0), lambda s, x: s + x.worth), 3).alias("score"), F.array_sort(F.transform("hit", lambda x: F.concat_ws(":", x.label, x.needle))).alias("matched")
    )
    return ranked.filter("score > 0").orderBy(F.desc("score"), F.coalesce("stars", F.lit(-1)).desc(), F.lower("name"), "id").limit(limit)


def blocked_hashes(records: DataFrame) -> DataFrame:
    return records.filter("verdict = 'block'").select("bundle_hash").distinct()


def excluded_blocked(catalog: DataFrame, blocked: DataFrame) -> DataFrame:
    return catalog.filter("bundle_hash != ''").join(blocked, "bundle_hash", "left_semi").agg(F.count("*").alias("excluded_blocked"))


def select(candidates: DataFrame, chosen: list[str], limit: int = 3) -> DataFrame:
    """Candidates of the chosen ids in the order given; at most `limit`, none twice, none unknown."""
    if not chosen:
        raise SelectionError("nothing was chosen")
    if len(chosen) > limit:
        raise SelectionError(f"{len(chosen)} chosen; at most {limit} can be")
    if twice := sorted({i for i in chosen if chosen.count(i) > 1}):
        raise SelectionError(f"chosen more than once: {', '.join(twice)}")
    order = candidates.sparkSession.createDataFrame([(i, n) for n, i in enumerate(chosen)], "id string, rank int")
    out = candidates.join(F.broadcast(order), "id")
    known = {r["id"] for r in out.select("id").collect()}
    if unknown := [i for i in chosen if i not in known]:
        raise SelectionError(f"not among the candidates: {', '.join(unknown)}")
    return out.orderBy("rank")


def repo_warnings(chosen: DataFrame) -> DataFrame:
    """Repositories that more than one chosen entry comes from, with their ids."""
    return chosen.filter("repo is not null").groupBy("repo").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)


def is_relevant(tokens: Column, needles: Column) -> Column:
    """Whether any token is a needle; without needles everything is relevant."""
    return (F.size(needles) == 0) | F.arrays_overlap(tokens, needles)
