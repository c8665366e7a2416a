import pytest

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(40_000))

#: (doc_id, text, source): nulls, empty, blank, long, repeated rows, odd blanks
CASES = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t\n ", None), (4, LONG, "b"), (5, "one two three", "b"), (5, "one two three", "b"), (6, "one two three", None),
    (7, "Ünïcode wörds\x0band odd blanks  two", "b"), (8, "line one\nline two\nline one\n\nline one", "c"), (9, "a b c d e f g h " * 12, "c"),
    (10, "ALL CAPS!!! $$$ ### 12345 <|endoftext|> don't", "c"), (None, "a row without an id", "c"),
]


@pytest.fixture(scope="session")
def cases(spark):
    """The odd documents, with further columns whose names clash with the operators' own."""
    rows = [(*r, "x", 0.5, "clash", 7) for r in CASES]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, kept double, fp string, n_words int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(400)] + [(9000, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
