import re
from collections import Counter, defaultdict

from corpusforge.llm.divergence import divergence, shares


def brute(rows, min_docs, top):
    rows = [((lang or ""), (source or ""), Counter(re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or ""))) for lang, source, text in rows]
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in rows:
        docs[lang].update(terms.keys())
        groups[lang, source].update(terms)
    out = set()
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept)) for t in kept}
        p, q = share(groups[lang, source]), share(sum((c for (g, _), c in groups.items() if g == lang), Counter()))
        pair = []
        for (other_lang, other), counts in groups.items():
            if other_lang == lang and other != source:
                o = share(counts)
                pair.append((-sum(abs(p[t] - o[t]) for t in kept), other))
        term = [(q[t] - p[t], t) for t in kept if groups[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pair), ("term", sorted(term)[:top])):
            out |= {(lang, source, part, item, -v, i) for i, (v, item) in enumerate(sorted(found), 1)}
    return out


ROWS = [
    *[("en", f"s{i % 7}", "the quick Fox é " + "word " * (i % 5) + f"rare{'x' * (i % 3)} 日本") for i in range(60)], ("en", None, None), ("en", "", "the"), (None, "a", "only here"), (None, "b", ""), (None, "b", None),
    ("xx", "alone", "the the the fox"), ("xx", "alone", "fox the"), ("fr", "a", "12 !! 3"), ("fr", "b", "le"), ("EN", "s0", "the"),
]


def frame(spark, rows):
    return spark.createDataFrame([(lang, source, text, 1, "x") for lang, source, text in rows], "lang string, source string, text string, n int, term string")


def test_against_brute_force(spark):
    df = frame(spark, ROWS)
    for min_docs, top, sizes in ((2, 50, {}), (2, 2, {"block": 2, "chunk": 2, "stripe": 1}), (30, 3, {"block": 3, "chunk": 3, "stripe": 2})):
        got = divergence(df, min_docs, top, **sizes).collect()
        assert {tuple(r) for r in got} == brute(ROWS, min_docs, top) and len(got) == len({tuple(r) for r in got})


def test_shares_are_exact():
    import numpy as np

    for total, v in ((0, 1), (17, 3), (8 * 10**15, 10**6), (10**12 + 7, 999_983)):
        counts = np.array([0, 1, total // 3, total], np.int64)
        assert shares(counts, total, v).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * v) for c in counts]


def test_odd_tables(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    odd = odd_docs.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "de"), "source": F.when(F.col("doc_id") > 4, "s")})
    assert {tuple(r) for r in divergence(odd, 2).collect()} == brute([(r.lang, r.source, r.text) for r in odd.collect()], 2, 50)
    assert divergence(no_docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")})).count() == 0
