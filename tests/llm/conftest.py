import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
PROSE = "The river ran past the old mill and the miller watched it from the window of his house every single morning. " * 3


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that operators may use inside."""
    rows = [(1, PROSE, "en", "a", 10), (2, PROSE, "en", "a", 10), (2, PROSE, "en", "a", 10), (3, None, "en", "a", None), (4, "", None, None, 0),
            (None, PROSE + "end", "en", "b", 3), (None, None, None, None, None), (5, LONG, "en", "a", 9), (6, "two words", "de", "b", 2),
            (6, "other text of the same id", "de", "b", 2), (7, " \n\t ", "de", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["bits", "key_id", "key_text", "host", "line", "doc", "lead", "start", "value", "component_id", "piece", "length", "words", "count", "n_words"]
    return docs.select("*", *[F.lit(k).alias(k) for k in clash])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
