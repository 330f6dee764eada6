import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns with names that operators use inside."""
    base = " ".join(f"word{i % 700}x{i // 700}" for i in range(30_000))
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, base, "en", None, None), (4, "one two", None, "s", 7), (4, "one two", None, "s", 7),
        (5, "Licensed under CC BY-NC 4.0.\nAll rights reserved.", "en", "s", 1), (None, "no id here", "en", "s", 1), (6, "été — \U0001f600 123", "fr", "s", 3), (7, "a  b\t\tc\n\n\nd ", "en", "s", 5), (8, base, "en", "s", 1), (9, "   \n ", "xx", "s", 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("k", "t", "key", "digest", "part", "group", "h", "size", "score", "stratum", "_s", "label", "start"):
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
