import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and blank texts, a text without spaces, ties, repeated rows.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "s", 43),
    (2, "the quick brown fox jumps over the lazy dog", "en", "s", 43),
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (5, " \n\t ", "en", "s", 4),
    (6, "x" * 5000, "en", "s", 5000),
    (7, "Ünïcödé 😀 <|endoftext|> text with odd  spaces \n\n and 'quotes'll", "de", None, 10),
    (8, "one two", "en", "s", 7),
    (8, "one two", "en", "s", 7),
    (9, "word " * 6000, "en", "s", 30000),
    (None, "no id at all but some words here", "en", "s", 5),
    (None, "no id at all but some words here", "en", "s", 5),
    (10, "released under the MIT License and more", "en", "s", 1),
    (11, "line one is here\nline one is here\nline one is here", "en", "s", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    names = ("key", "row", "x", "rid", "mark", "score", "ids", "n", "word", "task", "count", "bands", "keeper", "w", "l", "kept", "posterior", "length", "rank", "term", "weight", "training", "value", "__key")
    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
