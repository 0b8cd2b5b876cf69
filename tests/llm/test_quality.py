import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from corpusforge.llm.quality_classifier import FactorisationMachine, features, fit_quality, op5_quality_classifier, score_quality
from corpusforge.llm.quality_rules import apply_quality_rules, keep_by_quality, op1_quality_rules, text_statistics
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_counts_of_odd_texts(odd_docs, no_docs):
    from pyspark.sql import functions as F

    texts = [r["text"] for r in odd_docs.select("text").collect()]
    got = Counter(tuple(r[c] for c in COLUMNS) for r in text_statistics(odd_docs.select("doc_id", "text", F.lit("x").alias("n_words"))).collect())
    assert got == Counter(map(expected, texts))
    assert text_statistics(no_docs.select("doc_id", "text")).count() == 0


def test_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op1_quality_rules(spark, SMALL).collect():
        assert tuple(r[c] for c in COLUMNS) == expected(texts[r["doc_id"]])
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_rules_separate_labelled_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in op1_quality_rules(spark, "/root/testdata/sf0.01").collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(r["kept"] == (labels[r["doc_id"]] == 1) for r in rows) / len(rows) > 0.95


def test_odd_rows_and_empty_tables(odd_docs, no_docs, labels):
    assert apply_quality_rules(odd_docs, labels).count() == 15
    assert apply_quality_rules(odd_docs, labels.limit(0)).filter("not base_failed and not kept").count() == 0
    assert apply_quality_rules(no_docs, labels).count() == 0
    kept = keep_by_quality(odd_docs, labels.limit(0))
    judged = Counter((r["doc_id"], r["kept"]) for r in apply_quality_rules(odd_docs, labels.limit(0)).collect())
    assert kept.columns == odd_docs.columns and Counter((r["doc_id"], True) for r in kept.collect()) == Counter({k: n for k, n in judged.items() if k[1]})
    assert keep_by_quality(no_docs, labels).count() == 0
    model = fit_quality(odd_docs, labels)
    scores = score_quality(odd_docs, model).collect()
    assert len(scores) == 15 and all(0 <= r["score"] <= 1 for r in scores)
    assert score_quality(no_docs, fit_quality(no_docs, labels)).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in op5_quality_classifier(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows) > 0.9


def test_pair_term_against_all_pairs():
    rng = np.random.default_rng(1)
    ids, values, offsets = features(pa.array(["some words and some more | 12!", "", "A line\nand a line\nand a line"]))
    machine = FactorisationMachine(0.3, rng.standard_normal(1 << 16), rng.standard_normal((1 << 16, 5)))
    margin, _ = machine.margin(ids, values, offsets)
    for k in range(3):
        i, x = ids[offsets[k] : offsets[k + 1]], values[offsets[k] : offsets[k + 1]]
        pairs = sum(machine.factors[i[a]] @ machine.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(margin[k], 0.3 + machine.linear[i] @ x + pairs)


def test_rules_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = [r for r in op1_quality_rules(spark, folder).collect() if r["doc_id"] in labels and held(r["doc_id"]) and not r["base_failed"]]
    low, good = ([r["kept"] for r in rows if labels[r["doc_id"]] == k] for k in (0, 1))
    assert sum(low) / len(low) < 0.1 and sum(good) / len(good) > 0.98
