import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm.common import matched
from corpusforge.llm.components import components
from corpusforge.llm.embedding_dedup import fit_tables, near_duplicates, op10_embedding_dedup
from corpusforge.llm.ngram_join import clustered_sets, linked_sets, ngram_join, one_of_each_group, op3_ngram_join
from corpusforge.llm.queries import ORACLE_SQL
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_set(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def random_docs(seed, families=12, copies=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    docs = []
    for _ in range(families):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.5:
            words = words[:40] + passage + words[40:]
        for _ in range(rng.randint(1, copies)):
            mine = list(words)
            for _ in range(rng.randint(0, 4)):
                mine[rng.randrange(len(mine))] = rng.choice(vocabulary)
            docs.append(" ".join(mine).upper() if rng.random() < 0.2 else " ".join(mine))
    return [(i, t) for i, t in enumerate(docs)] + [(1000, None), (1001, ""), (1002, "w1 w2"), (1003, "w1 w2"), (1004, "w2 w1")]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [1024, 5])
def test_ngram_join_against_brute_force(spark, seed, block):
    docs = random_docs(seed)
    sets = {i: word_set(t, 4) for i, t in docs}
    linked = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    rows = ngram_join(spark.createDataFrame(docs, "doc_id bigint, text string"), block=block).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(sorted(sets), linked)


def test_query_against_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({ORACLE_SQL['op3_ngram_join']})").fetchall()
    got = op3_ngram_join(spark, SMALL).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_trie_against_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 40, 60)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 1 << 40, 60), base)) for _ in range(40)]
    linked = lambda a, b: 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))
    want = brute_components(range(40), linked)
    found = linked_sets(list(range(40)), sets, 80)
    pairs = {frozenset(x) for x in found}
    assert brute_components(range(40), lambda a, b: frozenset((a, b)) in pairs) == want and all(linked(*sorted(p)) for p in pairs)


def test_ngram_join_odd_rows(odd_docs, no_docs):
    rows = ngram_join(odd_docs).collect()
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == 15 and found[2] == 1 and found[3] == 3 and found[None] is None
    assert ngram_join(no_docs).count() == 0
    kept = one_of_each_group(odd_docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd_docs.columns and len(ids) == len(set(ids)) and 2 not in ids and None in ids
    assert one_of_each_group(no_docs).count() == 0


def test_rows_that_share_a_doc_id(spark, odd_docs):
    t1, t2, t3 = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(3, t1), (5, t1), (5, t2), (7, t2 + " end"), (7, t2 + " end"), (9, t3), (9, "other words of the same id"), (11, None), (11, None), (None, t1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = ngram_join(docs, 5, 80).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(3, 3), (5, 3), (7, 3), (9, 9), (11, 11), (None, None)}
    kept = [tuple(r) for r in one_of_each_group(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, t1), (5, t2), (9, t3), rows[6], (11, None), (None, t1)], key=str)
    assert [r["text"] for r in one_of_each_group(odd_docs).filter("doc_id = 12").collect()] == ["another text of the same id " * 5]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    for few in (0, 5, 50_000):
        got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), few).collect()}
        assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 32))
    x = np.concatenate([centres, *(centres[: 60 // k] + rng.standard_normal((60 // k, 32)) * 0.12 * k for k in (1, 2, 3))]).astype(np.float32)
    x[5] = x[6]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 0), (903, [1.0, None] * 16, 0), (904, [1.0], 0), (905, [], 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    for options in ({}, {"block_bytes": 1, "crowded": 2}, {"few": 0, "crowded": 3}):
        got = {r["vec_id"]: r for r in near_duplicates(table, **options).collect()}
        assert len(got) == len(rows)
        links = sum(got[i]["n_links"] for i in range(len(x)))
        assert 0.9 * close.sum() <= links <= close.sum() and all(got[i]["n_links"] <= close[i].sum() for i in range(len(x)))
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in range(900, 906))
        assert got[5]["component_id"] == got[6]["component_id"]


def test_embedding_rows_that_repeat(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (None, [1.0, 0.0])]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_embeddings_of_one_class(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(4)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(i, 3, 0, i == 0) for i in range(4)]


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def beside(base, cosine, rng):
    """Vectors at a cosine from those of base."""
    aside = rng.standard_normal(base.shape)
    return cosine * base + (1 - cosine**2) ** 0.5 * unit(aside - (aside * base).sum(1)[:, None] * base)


def test_tables_for_dense_rows():
    rng = np.random.default_rng(1)
    cone = beside(np.repeat(unit(rng.standard_normal((1, 64))), 500, 0), 0.9, rng)
    base = np.concatenate([cone, unit(rng.standard_normal((1000, 64)))])
    copies = beside(base, 0.902, rng)
    tables = fit_tables(base, 1_000_000, 0.9)
    a, b = tables.project(base), tables.project(copies)
    met = np.zeros(len(base), bool)
    for t in range(tables.n_tables):
        met |= (tables.keys(a, t)[:, :, None] == tables.keys(b, t)[:, None, :]).any((1, 2))
    assert met[:500].mean() >= 0.9 and met[500:].mean() >= 0.9
    for close in (unit(base[:1] + 1e-3 * copies[:200]), unit(base[:1] + 0.03 * copies[:200]), base[:1]):
        assert fit_tables(close, 1_000_000, 0.9).n_tables < 60


@pytest.mark.parametrize("kind", ["cone", "tight", "lengths", "wide"])
def test_embedding_recall(spark, kind):
    rng = np.random.default_rng(7)
    dims = 96 if kind == "wide" else 24
    if kind == "tight":
        base = beside(np.repeat(unit(rng.standard_normal((1, dims))), 300, 0), 0.99, rng)
    elif kind == "cone":
        base = beside(np.repeat(unit(rng.standard_normal((1, dims))), 300, 0), 0.8, rng)
    else:
        base = unit(rng.standard_normal((300, dims)))
    x = np.concatenate([base, beside(base[:100], 0.92, rng), beside(base[:50], 0.97, rng)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    x = unit(x.astype(float))
    close = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    if kind == "lengths":  # every third vector is of another length: what stands at its end is left out
        keep = [dims - 4 if i % 3 == 0 else dims for i in range(len(rows))]
        rows = [(i, v[:n]) for (i, v), n in zip(rows, keep)]
        cut = [unit(np.array([v])) [0] for _, v in rows]
        close = np.array([[a is not b and len(a) == len(b) and a @ b >= 0.9 for b in cut] for a in cut])
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    assert sum(got.values()) >= 0.9 * close.sum() and all(got[i] <= close[i].sum() for i in got)


def test_embedding_query(spark):
    rows = op10_embedding_dedup(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()


def judged(spark, x, **options):
    """links found, links there are, and vector pairs compared for each of them."""
    report = {}
    got = {r["vec_id"]: r for r in near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>"), report=report, **options).collect()}
    u = unit(np.asarray(x, np.float32).astype(float))
    close = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    assert all(got[i]["n_links"] <= close[i].sum() for i in got)
    return sum(r["n_links"] for r in got.values()), int(close.sum()), 2 * (report["dense"] + report["sparse"]) / close.sum(), report, got


@pytest.mark.parametrize("cosine", [0.59, 0.78])
def test_vectors_about_a_mean_make_no_large_clusters(spark, cosine):
    rng = np.random.default_rng(3)
    mean = unit(rng.standard_normal((1, 64)))
    base = beside(np.repeat(mean, 250, 0), cosine**0.5, rng)
    found, there, cost, report, _ = judged(spark, beside(np.repeat(base, 12, 0), 0.96, rng))
    assert found >= 0.9 * there and cost <= 20
    assert report["tables"][64].mean.any()  # centred


def test_chained_vectors_are_compared_by_pairs(spark):
    """A curve: every vector is near some before and after it, so all candidates hang together, with a dense group at one place."""
    t = np.arange(3000)[:, None] * 0.02
    speed = np.array([1.0, 1.7, 2.3, 3.1, 4.3, 5.9, 7.1, 8.3])
    x = np.concatenate([np.hstack([np.cos(t * speed), np.sin(t * speed)]), np.repeat(np.hstack([np.cos(t[:1] * speed), np.sin(t[:1] * speed)]), 60, 0) + 0.01 * np.random.default_rng(1).standard_normal((60, 16))])
    found, there, cost, report, got = judged(spark, x)
    assert report["sparse"] > 0 and found >= 0.9 * there and cost <= 20
    again, _, _, whole, _ = judged(spark, x, crowded=2)
    assert again >= 0.9 * there


def test_pairs_are_given_once(spark):
    from corpusforge.llm.embedding_dedup import Tables, candidate_pairs, entry_type

    rows = np.zeros(6, entry_type(96))
    rows["cell"], rows["node"] = [1, 1, 1, 2, 2, 3], [5, 7, 5, 7, 5, 9]
    tables = {4: Tables(np.zeros(4), np.eye(4), 4, 1, 0, 96, 0)}
    frame = spark.createDataFrame([(0, 4, bytearray(rows.tobytes())), (1, 4, bytearray(rows[:2].tobytes()))], "sub bigint, dims int, content binary")
    assert [tuple(r) for r in candidate_pairs(frame, tables).collect()] == [(5, 7)]
    assert candidate_pairs(frame.limit(0), tables).count() == 0


def test_texts_are_not_shuffled_to_many_keys(spark):
    """A million keys and more are broadcast, in groups where need be; documents stay where they are read."""
    docs = spark.createDataFrame([(i, f"a b c d e f {i}") for i in range(40)] + [(None, "x")], "doc_id bigint, text string")
    keys = spark.createDataFrame([(i, 7) for i in range(0, 40, 3)], "id bigint, component bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = clustered_sets(docs, keys, 1_000_000, 4)
        assert "SortMergeJoin" not in sets._jdf.queryExecution().toString()
        assert sorted(r["id"] for r in sets.collect()) == list(range(0, 40, 3))
        for how in ("left_anti", "left_semi", "inner"):
            grouped = matched(docs, keys.select(F.col("id").alias("doc_id")), 14, "doc_id", how, most=3)
            kept = [r[0] for r in docs.select("doc_id").collect() if (r[0] is not None and r[0] % 3 == 0) == (how != "left_anti")]
            assert sorted(map(str, (r["doc_id"] for r in grouped.collect()))) == sorted(map(str, kept))
            assert "SortMergeJoin" not in grouped._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
