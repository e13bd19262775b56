import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, copies and repeated rows."""
    long = " ".join(f"word{i} and more." for i in range(6000))
    rows = [(1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "a", None), (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "a", None)]
    rows += [(2, None, None, None, None), (3, "", "en", None, 0), (None, "some words here", "en", "b", 15), (4, "   \n\t ", None, "a", 6)]
    rows += [(5, long, "en", "a", len(long)), (6, long, "en", "b", len(long)), (7, "x" * 30000, "de", "b", 30000), (8, "mail me at jo.12@mail3.example.com now", "en", "a", 38)]
    rows += [(10 + i, f"A plain sentence number {i} with words that differ by {i * i} in places, and so on it goes.", "en", "a", None) for i in range(12)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
