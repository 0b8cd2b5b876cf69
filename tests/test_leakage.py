import random
import tracemalloc

import pyarrow as pa

from corpusforge.functions.text import norm_key_full
from corpusforge.operators import leakage
from corpusforge.operators.evaluate import leaks


def found(spark, items, texts):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    return sorted(r.item_id for r in leaks(frame(list(enumerate(items)), "item_id int, text string"), frame(list(enumerate(texts)), "doc int, text string")).collect())


def test_passages_across_bodies(spark):
    texts = ["One two three.", None, "  \n ", "four  FIVE six:", "", "seven", "eight nine;"]
    items = ["three. four five", "two three.", "six: seven eight", "five six seven", "nine", "eight nine", "three. four five ", None, "", "SEVEN EIGHT", "three four five", "eight nine;"]
    assert found(spark, items, texts) == [0, 1, 2, 5, 6, 9, 11]
    assert found(spark, [None, "short"], texts) == [] and found(spark, ["one two three"], []) == []


def test_small_blocks_against_one_string(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(leakage, "BLOCK", 64)
    monkeypatch.setattr(leakage, "NEEDLES", 60)
    texts = ["".join(rng.choice("abé .\n") for _ in range(rng.choice([0, 1, 3, 20, 400]))) for _ in range(60)]
    hay = spark.createDataFrame([(" \n ".join(texts),)], "t string").select(norm_key_full("t")).first()[0]
    items = [hay[i : i + n] for i, n in ((rng.randrange(len(hay) - 40), rng.choice([8, 9, 17, 33])) for _ in range(40))] + ["".join(rng.choice("abé ") for _ in range(8)) for _ in range(40)]
    keys = [r[0] for r in spark.createDataFrame([(t,) for t in items], "t string").select(norm_key_full("t")).collect()]
    want = [i for i, k in enumerate(keys) if len(k) >= 8 and k in hay]
    assert found(spark, items, texts) == want and len(want) > 20


def test_one_text_of_a_batch_at_a_time():
    texts = [f"{i:04d} " * 1000 for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], ["block", "text"])
    tracemalloc.start()
    hits = list(leakage._searcher(["0007 0007", "0007 0008", "0399 0399"])(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(h for b in hits for h in b.column("needle").to_pylist()) == ["0007 0007", "0399 0399"] and peak < batch.nbytes / 5
