import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from corpusforge.llm import spelling
from corpusforge.llm.terms import latin_letters, letters_or_beyond_ascii, runs


def brute_forms(words: dict, ratio: int = 10) -> dict:
    near, masked = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masked[w[:i], w[i + 1 :]].add(w)
    for w in words:
        for i in range(len(w)):
            near[w] |= masked[w[:i], w[i + 1 :]] - {w}
            if (cut := w[:i] + w[i + 1 :]) in words:
                near[w].add(cut)
                near[cut].add(w)
    form = {w: best for w in words if near[w] and words[best := min(near[w], key=lambda x: (-words[x], x))] >= ratio * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def as_dict(df) -> dict:
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_tree_reports_what_lies_in_a_range():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64, 300):
        values = rng.permutation(n)
        lo, hi, low, high = (rng.integers(0, n + 1, 200) for _ in range(4))
        query, found = spelling.WaveletTree(values).report(lo, hi, low, high)
        want = {(q, v) for q in range(200) for v in values[lo[q] : hi[q]].tolist() if low[q] <= v < high[q]}
        assert set(zip(query.tolist(), found.tolist())) == want and len(query) == len(want)


def test_crc_goes_on_from_a_start():
    rng = random.Random(3)
    parts = [rng.randbytes(n) for n in (0, 1, 5, 63, 64, 65, 3000, 12)]
    starts = [zlib.crc32(b"%d:" % i) for i in range(len(parts))]
    ends = np.cumsum([len(p) for p in parts])
    got = spelling.crc32_after(np.array(starts, np.uint32), np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], np.array([len(p) for p in parts]))
    assert got.tolist() == [zlib.crc32(p, s) for p, s in zip(parts, starts)]


def test_runs_are_those_of_patterns():
    texts = ["Ab cÀÿ×xĀy", None, "", "ß_é1Zz", "日本 x¿qÃ", "A", "Ã" * 3 + "-ÿ"]
    for inside, pattern in ((latin_letters, "[A-Za-zÀ-ÿ]+"), (letters_or_beyond_ascii, "[^\x00-\x40\x5b-\x60\x7b-\x7f]+")):
        for part in (pa.array(texts), pa.array(["zz", *texts, "zz"]).slice(1, len(texts))):
            found, row = runs(part, inside)
            want = [(i, re.sub("[A-Z]+", lambda m: m[0].lower(), x)) for i, t in enumerate(texts) for x in re.findall(pattern, t or "")]
            assert list(zip(row.tolist(), found.to_pylist())) == want


def test_forms_of_random_words(spark):
    """Few letters, so that words have many near ones; small buckets, so that windows are halved down to one position."""
    rng = random.Random(7)
    words = {"".join(rng.choice("abßÿ") for _ in range(rng.randint(1, 8))): int(10 ** rng.uniform(0, 7)) for _ in range(1500)} | {"x" * 300: 5, "x" * 299: 70, "x" * 301: 7000, "é": 1}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    want = brute_forms(words)
    assert as_dict(spelling.variant_forms(frame)) == want
    near = {r.word: (r.n_near, r.best.near, -r.best.less) for r in spelling.near_words(frame, max_cells=12, chunk_cells=500).collect()}
    assert near == {r.word: (r.n_near, r.best.near, -r.best.less) for r in spelling.near_words(frame).collect()}
    assert {w: x[0] for w, x in near.items()} == {w: x[3] for w, x in want.items() if x[3]}
    sizes = spelling._in_buckets(frame, 12).groupBy("base", "a", "b", "bucket").count().filter("b > a + 1 and count * (b - a) > 12")
    assert sizes.count() == 0


def test_forms_follow_to_the_last(spark):
    chain = ["abcdefg" + "xyz"[:i] for i in range(4)]
    words = {w: 2 * 10**i for i, w in enumerate(chain)}
    got = as_dict(spelling.variant_forms(spark.createDataFrame(list(words.items()), "word string, n bigint")))
    assert [got[w][:2] for w in chain] == [(chain[1], chain[3]), (chain[2], chain[3]), (chain[3], chain[3]), (None, chain[3])]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(9, "Ångström" * 2000), (9, "Ångström" * 2000), (None, "Schön Straßenbahn STRASSENBAHN")]
    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            want[word] += len(word) >= 4
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n int")
    assert {r.word: r.n for r in spelling.slipped_words(frame, min_length=4).collect()} == {w: n for w, n in want.items() if n}
    assert spelling.variant_forms(spelling.slipped_words(no_docs)).count() == 0
    assert as_dict(spelling.variant_forms(spelling.slipped_words(frame, min_length=4))) == brute_forms({w: n for w, n in want.items() if n})


def test_long_words_stand_apart():
    base = np.array([7, 7, 9, 30, 31, 77, 90, 60_000], np.int32)
    rows = pa.table({"base": base, "n": np.arange(8)})
    parts = [p.column("n").to_pylist() for p in spelling._alike(rows)]
    assert parts == [[0, 1, 2, 3], [4, 5], [6], [7]] and list(spelling._alike(rows.slice(0, 0))) == []
