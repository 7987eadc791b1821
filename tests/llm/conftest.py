import pytest

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, size LONG, score DOUBLE, kept BOOLEAN, h LONG"


def rows_of(texts):
    """Documents with columns that clash with names used inside the operators."""
    return [(i, t, "en", "s", None, 7, 0.5, True, 1) for i, t in texts]


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and blank texts, repeated rows, a repeated id, a missing id, a long text, no letters."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
    texts = [
        (1, None), (2, ""), (3, "   "), (4, "one two three four five six seven"), (5, "one two three four five six seven"),
        (5, "one two three four five six seven"), (5, "another text under the same id, long enough for a fifty byte piece of it"), (None, "no id here"),
        (None, "no id here"), (6, long), (7, long + " end"), (8, "12345 67890 !!"), (9, "Σίσυφος ΣΊΣΥΦΟΣ \x1c odd <|endoftext|> text"), (10, "a"),
    ]
    return docs_of(texts), texts
