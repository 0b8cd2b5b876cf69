import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.operators import dedupe, evaluate, ranking


def test_tokens(spark):
    rows = [("Uses C# and C++ with node.js -- the API-first way.", ["c#", "c++", "node.js", "api-first", "way"]), (None, []), ("a an of", []), ("...go... go", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(T.tokenize("t")).collect()] == [want for _, want in rows]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aßÉé́ſK .:;\n\t ", max_size=12), min_size=1, max_size=20))
def test_full_key_is_composed_and_folded(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [" ".join(unicodedata.normalize("NFC", t).split()).casefold().rstrip(".:;").strip() for t in texts]
    assert [r[0] for r in df.orderBy("i").select(T.norm_key_full("t")).collect()] == want


def test_key_is_the_full_key(spark):
    texts = ["cafe\u0301 Noir.", "CAF\u00c9  noir", "\u017ft \ufb01n", "ST FIN", "\u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03bf\u03c2", "a\x1cb", "A b ..", " \x0b x;\n", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    keys = [r[0] for r in df.select(T.norm_key("t")).collect()]
    assert keys == [r[0] for r in df.select(T.norm_key_full("t")).collect()]
    assert all(keys[i] == keys[i + 1] for i in (0, 2, 4, 6))


def test_copies_and_leaks_in_other_forms(spark):
    docs = spark.createDataFrame([(1, "Une page du cafe\u0301 noir ici"), (2, "une page du CAF\u00c9 noir ici."), (3, "e\ufb03cient")], "doc int, text string")
    collapsed = dedupe.collapse(docs.select(F.col("doc").alias("id"), F.lit("s").alias("skill"), F.col("doc").alias("source_order"), T.norm_key("text").alias("norm_key")))
    assert {r.id: r.survivor for r in collapsed.collect()} == {1: 1, 2: 1, 3: 3}
    items = spark.createDataFrame([(1, "page du caf\u00e9 noir"), (2, "efficient"), (3, "not in any text")], "item_id int, text string")
    assert sorted(r.item_id for r in evaluate.leaks(items, docs).collect()) == [1, 2]


def test_native_key(spark):
    df = spark.createDataFrame([(0, " Use   TLS. "), (1, "use tls"), (2, "Straße :"), (3, "STRASSE")], "i int, t string")
    keys = [r[0] for r in df.orderBy("i").select(T.norm_key("t")).collect()]
    assert keys[0] == keys[1] and keys[2] == keys[3]


def test_slug_and_lines(spark):
    df = spark.createDataFrame([("A + B!",), ("***",), ("x" * 80,)], "t string")
    assert [r[0] for r in df.select(T.slug("t")).collect()] == ["a-b", "skill", "x" * 64]
    lines = T.explode_lines(spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, "x\r\ny")], "i int, text string")).collect()
    assert [(r.i, r.line_no, r.line) for r in lines] == [(1, 1, "a"), (1, 2, "b"), (3, 1, "x"), (3, 2, "y")]


def test_intake(spark):
    df = spark.createDataFrame([("help me do some stuff please",), ("lint",), ("review python pull requests carefully",)], "t string")
    assert [(r.thin, len(r.reasons)) for r in T.intake(df, "t").collect()] == [(True, 1), (True, 1), (False, 0)]


ENTRY = "id string, name string, description string, languages array<string>, tags array<string>, stars int, bundle_hash string"


def catalog(spark):
    return spark.createDataFrame(
        [
            ("a", "Flask helper", "builds flask services", ["Python"], ["web"], 5, "h1"), ("b", "Broad", "python web flask react vue", ["python"], [], 50, "h2"),
            ("c", "Other", "nothing here", ["go"], [], 9, "h3"), ("d", "Zed", "python tool", ["python"], [], None, "h4"), ("e", "Abe", "python tool", ["python"], [], None, "h5"),
        ],
        ENTRY,
    )


def profile(spark, **given):
    base = {"summary": "", "languages": [], "frameworks": [], "conventions": [], "tasks": []} | given
    return spark.createDataFrame([tuple(base.values())], "summary string, languages array<string>, frameworks array<string>, conventions array<string>, tasks array<string>")


def test_discover(spark):
    found = ranking.discover(catalog(spark), profile(spark, languages=["Python "], frameworks=["flask"])).collect()
    assert [r.id for r in found] == ["b", "a", "e", "d"] and found[0].matched == ["framework:flask", "language:python"]
    assert [r.id for r in ranking.discover(catalog(spark), profile(spark, languages=["python"]), limit=1).collect()] == ["b"]
    blocked = spark.createDataFrame([("h2",), ("",)], "bundle_hash string")
    less = ranking.discover(catalog(spark), profile(spark, languages=["python"], frameworks=["flask"]), blocked).collect()
    assert [r.id for r in less] == ["a", "e", "d"] and less[0].score == found[1].score
    assert ranking.excluded_blocked(catalog(spark), blocked).first()[0] == 1


def test_needles_of_several_words(spark):
    found = ranking.discover(catalog(spark), profile(spark, frameworks=["flask services"], conventions=["react vue"])).collect()
    assert {r.id: r.matched for r in found} == {"a": ["framework:flask services"], "b": ["convention:react vue"]}


def test_select(spark):
    assert [r.id for r in ranking.select(catalog(spark), ["c", "a"]).collect()] == ["c", "a"]
    for bad in ([], ["a", "a"], ["a", "b", "c", "d"], ["nope"]):
        with pytest.raises(ranking.SelectionError):
            ranking.select(catalog(spark), bad)


def test_key_of_latin_texts_without_python(spark):
    kept = [chr(c) for c in range(256) if not (c != 32 and chr(c).isspace() and not "\t" <= chr(c) <= "\r")]
    texts = ["".join(a + b for b in kept) for a in kept] + ["µ STRAßE Über: .;:", "ÿÀ .", "a   b", "\u0085x\u001f", "café́", " . : ", "x" + " " * 50_000 + "y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    want = [" ".join(unicodedata.normalize("NFC", t).split()).casefold().rstrip(".:;").strip() for t in texts]
    assert [r[0] for r in df.select(T.norm_key("t")).collect()] == want
    python = [r[0] for r in df.select(F.col("t").rlike(T._OTHER)).collect()]
    assert not any(python[: len(kept) + 2]) and python[len(kept) + 2 : len(kept) + 5] == [True] * 3


def test_key_holds_few_texts_of_a_batch_in_python():
    batch = pa.array(["жА " * 1000] * 2000)
    tracemalloc.start()
    keys = T._folded.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys.to_pylist() == ["жа " * 999 + "жа"] * 2000 and peak < batch.nbytes / 5
