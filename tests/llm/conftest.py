import pytest

#: Documents with nulls, empty and long texts, ties, repeated rows and columns with clashing names.
ROWS = [
    (1, "Alpha beta gamma delta.", "en", "kept"),
    (2, "Alpha  beta gamma\tdelta.", "en", "score"),
    (3, "alphabetagammadelta.", "en", None),
    (4, None, None, None),
    (5, "", "en", "x"),
    (6, " \n ", "fr", "x"),
    (None, "Alpha beta gamma delta.", "en", "x"),
    (7, "Alpha beta gamma delta.", "en", "x"),
    (7, "Alpha beta gamma delta.", "en", "x"),
    (8, "word " * 6000, "de", "x"),
    (9, "ünï ßtraße 😀 " * 40, "de", "x"),
    (10, "12 34 -- !!", "de", "x"),
]
SCHEMA = "doc_id long, text string, lang string, kept string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
