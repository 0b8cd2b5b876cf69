import pytest

DOC_SCHEMA = "doc_id bigint, text string, n_words string, toxicity double, row_key string, shard int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and extra columns whose names operators use."""
    base = "the quick brown fox jumps over the lazy dog near the old river bank while seven grey geese fly south "
    rows = [
        (1, base * 4), (2, base * 4), (2, base * 4), (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "two words"), (None, base * 3 + "alone"),
        (8, "word " * 60_000), (9, "\n".join(["same line here"] * 30)), (10, "MIT. Released under the MIT License. cc by nc é"), (11, "naïve ☃ \x1c text here  and   there "),
        (12, base * 4 + "tail"), (12, "another text of the same id " * 5),
    ]
    return spark.createDataFrame([(i, t, "x", None, "k", 3) for i, t in rows], DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 12)] + [(None, 1, 0), (1, None, None)], "doc_id bigint, quality int, toxic int")
