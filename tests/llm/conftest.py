import pytest

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000)) + "."
#: Columns that clash with names the operators use inside.
CLASHING = "recipe string, label long, word string, block long, spans string, n_chars long"


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows, negative ids."""
    return [
        (1, "same text here for all of us today"), (2, "same text here for all of us today"), (2, "same text here for all of us today"),
        (None, "same text here for all of us today"), (None, None), (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, LONG), (8, LONG + " tail"),
        (9, "ünïcode ẞtraße — mail me: a.b@c.de, +1 (988) 555-2485 or 10.0.0.1"), (-3, "one two three"), (10, "one two three"), (11, "x"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    rows = [(i, t, "en", "s", "r", 1, "w", 2, "p", 0) for i, t in edge_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + CLASHING)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
