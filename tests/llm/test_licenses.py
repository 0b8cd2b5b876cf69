import re

import pytest

from corpusforge.llm.licenses import PHRASES, TEMPLATES, Automaton, op2_license_scan, scan_licenses
from tests.conftest import SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for label, p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_optional_and_replaceable_regions():
    automaton = Automaton([("x", "one two [[three]] {{2}} four")])
    ids = automaton.words

    def accepts(text):
        words = [ids.get(w, -1) for w in text.split()]
        return automaton.matches(words, 0, len(words))

    for good in ("one two four", "one two three four", "one two three a b four", "one two a four", "one two a three four"):
        assert accepts(good), good
    for bad in ("one two", "one four", "one two a b c four", "one two three a b c four", "two four"):
        assert not accepts(bad), bad


def test_templates_must_open_with_words_and_close_regions():
    with pytest.raises(ValueError):
        Automaton([("x", "one {{3}} two")])
    with pytest.raises(ValueError):
        Automaton([("x", "one two [[three")])


def test_query_against_brute_force(spark, odd_docs):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op2_license_scan(spark, SMALL).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_odd_rows(odd_docs, no_docs):
    rows = scan_licenses(odd_docs).collect()
    assert len(rows) == 15 and scan_licenses(no_docs).count() == 0
    found = {r["doc_id"]: {m["label"] for m in r["found"]} for r in rows}
    assert found[10] == {"mit", "cc-by-nc"} and found[3] == found[4] == set()


def test_full_text_with_other_holder(spark):
    text = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    docs = spark.createDataFrame([(1, text), (2, text.replace("fee", "charge"))], "doc_id bigint, text string")
    found = {r["doc_id"]: {m["label"] for m in r["found"]} for r in scan_licenses(docs).collect()}
    assert found == {1: {"isc"}, 2: set()}


def test_long_templates_match_whole(spark):
    words = [f"w{i}" for i in range(9000)]
    docs = spark.createDataFrame([(1, "x " + " ".join(words)), (2, " ".join(words[:-1]))], "doc_id bigint, text string")
    found = {r["doc_id"]: [(m["first"], m["end"]) for m in r["found"]] for r in scan_licenses(docs, [("long", " ".join(words))]).collect()}
    assert found == {1: [(1, 9001)], 2: []}


def regex_of(template):
    out = ""
    for item in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[a-z0-9]+", template):
        out += {"[[": "(?:", "]]": ")?"}.get(item) or (f"(?:[^ ]+ ){{0,{item[2:-2]}}}" if item[0] == "{" else item + " ")
    return re.compile(out)


def test_labels_and_score_against_brute_force(spark, tmp_path):
    bodies = [re.sub(r"\[\[|\]\]", " ", re.sub(r"\{\{\d+\}\}", " some holder ", t)) for _, t in TEMPLATES]
    plain = [re.sub(r"\[\[[^\[\]]*\]\]", " ", re.sub(r"\{\{\d+\}\}", " ", t)) for _, t in TEMPLATES]
    texts = [f"Before it. {b.upper()} and after" for b in bodies + plain] + [b.replace(" the ", " thee ", 1) for b in bodies] + [" ".join(bodies), "no license", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    patterns = [(label, regex_of(p)) for label, p in PHRASES + TEMPLATES]
    for r in op2_license_scan(spark, str(tmp_path)).collect():
        words = WORD.findall(texts[r["doc_id"]].translate(LOWER))
        joined, labels, covered = " ".join(words) + " ", set(), set()
        starts = [m.start() for m in re.finditer(r"[^ ]+", joined)]
        for i, at in enumerate(starts):
            for label, pattern in patterns:
                ends = [j for j in range(i + 1, len(words) + 1) if pattern.fullmatch(joined, at, starts[j] if j < len(words) else len(joined))] if pattern.match(joined, at) else []
                if ends:
                    labels.add(label)
                    covered |= set(range(i, max(ends)))
        assert (r["labels"], r["n_words"]) == (",".join(sorted(labels)), len(words)) and abs(r["score"] - len(covered) / max(1, len(words))) < 1e-12, texts[r["doc_id"]][:80]
