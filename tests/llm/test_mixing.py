import random
from collections import Counter

from pyspark.sql import functions as F

from corpusforge.llm.mixing import mix, op13_source_mix, source_targets, with_rank
from tests.conftest import SMALL


def targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        unit = rest / (sum(weight[s] for s in names if s not in full) or 1)
        more = {s for s in names if s not in full and weight[s] * unit > 2 * sizes[s]}
        if not more:
            return {s: float(2 * sizes[s]) if s in full else weight[s] * unit for s in names}
        full |= more


def test_ranks_within_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None, ""]), rng.randint(0, 9), i) for i in range(500)]
    for within in (["g"], []):
        got = with_rank(spark.createDataFrame(rows, "g string, x int, i int"), within, [F.col("x"), F.col("i")], "__rank").collect()
        groups: dict = {}
        for r in sorted(got, key=lambda r: (r.x, r.i)):
            groups.setdefault(r.g if within else 0, []).append(r["__rank"])
        assert len(got) == 500 and all(v == list(range(len(v))) for v in groups.values())


def test_targets_fill_up(spark):
    rng = random.Random(8)
    for n in (1, 2, 3, 11, 40):
        sizes = {("ä" if i % 5 == 4 else "s") + str(i): int(10 ** rng.uniform(0, 6)) for i in range(n)} | {None: 12, "": 0}
        got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * want[s] for s in want)
        assert abs(sum(got.values()) / (1.5 * sum(sizes.values())) - 1) < 1e-12


def test_query_keeps_its_contract(spark):
    rows = op13_source_mix(spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        source = docs[r.doc_id].source
        sizes[source] += r.size
        taken[source] += r.taken
        longest[source] = max(longest[source], r.size)
        assert r.size == len((docs[r.doc_id].text or "").encode().split()) and r.taken in (0, r.size, 2 * r.size)
    want = targets(sizes)
    for r in rows:
        source = docs[r.doc_id].source
        assert r.source_size == sizes[source] and abs(r.target - want[source]) <= 1e-9 * want[source]
    assert len(rows) == len(docs) and all(abs(taken[s] - want[s]) <= longest[s] + 1 for s in want)


def test_reruns_and_other_partitions_agree(spark, odd_docs):
    docs = odd_docs.withColumns({"source": F.when(F.col("doc_id") < 9, F.col("doc_id") % 2).cast("string"), "target": F.lit("x"), "__rank": F.lit(1)})
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    first = mix(docs, size)
    found = sorted((str(r.doc_id), str(r.text)[:40], r.size, r.source_size, r.target, r.copies) for r in first.collect())
    again = mix(docs.repartition(3), size).collect()
    assert found == sorted((str(r.doc_id), str(r.text)[:40], r.size, r.source_size, r.target, r.copies) for r in again)
    assert len(found) == 15 and set(docs.columns) < set(first.columns) and all(0 <= f[-1] <= 2 for f in found)
    written = first.selectExpr("explode(sequence(1, copies)) as copy", "text").count() if all(f[-1] for f in found) else first.filter("copies > 0").selectExpr("explode(sequence(1, copies)) as copy", "text").count()
    assert written == sum(f[-1] for f in found)


def test_every_document_is_as_likely(spark):
    docs = spark.createDataFrame([(i, "s" if i < 30 else "t", 1 + i % 3) for i in range(90)], "doc_id int, source string, size int")
    seen, n = Counter(), 24
    for seed in range(n):
        for r in mix(docs, F.col("size"), seed=seed).collect():
            seen[r.source] += r.copies
    ratio = {r.source: r.target / r.source_size for r in mix(docs, F.col("size")).collect()}
    assert abs(seen["s"] / (30 * n) - ratio["s"]) < 0.01 and abs(seen["t"] / (60 * n) - ratio["t"]) < 0.01


def test_no_documents_and_none_with_words(spark, no_docs):
    docs = no_docs.withColumn("source", F.lit("x"))
    assert mix(docs, F.lit(1)).count() == 0
    empty = spark.createDataFrame([(1, "a"), (2, None), (None, None)], "doc_id int, source string")
    assert [(r.size, r.source_size, r.target, r.copies) for r in mix(empty, F.lit(None).cast("long")).collect()] == [(0, 0, 0.0, 0)] * 3
