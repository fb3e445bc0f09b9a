import duckdb
import pytest

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

EDGE = [
    (None, "one two three", "en", None, 1),
    (1, None, None, "a", 0),
    (2, "", "en", "a", 0),
    (3, "   \n\t\n ", "en", "a", 0),
    (4, "a b c d e a b c d e a b c d e f", "en", "a", 0),
    (4, "a b c d e a b c d e a b c d e f", "en", "a", 0),
    (5, "line one\nline one\nline two\r\n#*$%&|<> x", "de", "b", 0),
    (6, "x" * 70000, "en", "b", 0),
    (7, "z z z z z z z z z z z z", "fr", "b", 0),
    (8, "mail a.b+c@ex-ample.co.uk_d@e.f, ip 1.2.3.4.5.6.7.8 and 300.1.1.1 card 4111 1111 1111 1111, +1 (702) 555-0742 .", "es", "b", 0),
    (9, "é@x.y 日本a@b.c 𝒳 4111-1111-1111-1112 +49 30 1234567 0010.0.0.255", "es", "b", 0),
    (10, "12345678901234567890123 1.2.3 +1.2.3.4.5.6.7.8 +(1) +12 a@b a@b. a@b.c.", "es", "b", 0),
]


@pytest.fixture(scope="session")
def corpus():
    """All rows of the small documents table."""
    return duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use themselves."""

    def add(df):
        from pyspark.sql import functions as F

        for c in ("score", "host", "length", "offset", "_m", "_k1", "n_words", "line", "term", "kept", "size", "cls", "lo", "hi", "items"):
            df = df.withColumn(c, F.lit("clash"))
        return df

    return add
