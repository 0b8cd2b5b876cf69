import random
import zlib
from collections import Counter
from math import comb

from corpusforge.llm.sharding import communication_matrix, hypergeometric, op4_sharding, shard_rows
from tests.conftest import SMALL


def test_hypergeometric_follows_its_law():
    rng = random.Random(1)
    n = 40_000
    got = Counter(hypergeometric(rng, 6, 9, 5) for _ in range(n))
    for k in range(6):
        p = comb(6, k) * comb(9, 5 - k) / comb(15, 5)
        assert abs(got[k] / n - p) < 0.012


def test_matrix_sums():
    counts, room = [5, 0, 17, 8], [8, 7, 7, 8]
    matrix = communication_matrix(counts, room, random.Random(2))
    assert [sum(r) for r in matrix] == counts and [sum(c) for c in zip(*matrix)] == room


def test_large_populations():
    assert 0 <= hypergeometric(random.Random(3), 5 * 10**9, 35 * 10**9, 10**6) <= 10**6


def test_odd_rows(spark, odd_docs, no_docs):
    rows = shard_rows(odd_docs.withColumnsRenamed({"n_words": "__row", "row_key": "__part"}), 4, rows_a_part=2).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 15 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert shard_rows(no_docs, 4).count() == 0


def test_query_puts_every_document_in_a_place(spark):
    rows = op4_sharding(spark, SMALL).collect()
    places = {(r["shard"], r["slot"]) for r in rows}
    assert len(places) == len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in op4_sharding(spark, SMALL).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op4_sharding(spark, SMALL).collect():
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_shuffle_is_uniform(spark):
    """Over many seeds each of some equal rows is in each shard, and in each place, about as often."""
    docs = spark.range(12, numPartitions=3).selectExpr("id", "'same' as text")
    n = 60
    shards, first = Counter(), Counter()
    for seed in range(n):
        for r in shard_rows(docs, 4, seed=seed).collect():
            shards[r["id"], r["shard"]] += 1
            first[r["id"]] += r["slot"] == 0
    chi = sum((shards[i, s] - n / 4) ** 2 / (n / 4) for i in range(12) for s in range(4))
    assert chi < 70  # 36 - 3 degrees of freedom or so; one in a thousand lies above 64
    assert sum((first[i] - n / 3) ** 2 / (n / 3) for i in range(12)) < 45


def test_equal_rows_go_apart(spark):
    docs = spark.range(4000, numPartitions=4).selectExpr("'one' as text")
    slots = shard_rows(docs, 4).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in slots) == [1000] * 4
