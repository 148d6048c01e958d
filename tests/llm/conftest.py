import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, fp long, uid long, norm string, digest string, words string, kept boolean, size long, label int"

#: Nulls in every column, empty and blank texts, repeated rows, ties, control characters and a very long text.
EDGE = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s1"),
    (1, "alpha beta gamma delta epsilon zeta", "en", "s1"),
    (2, "alpha  beta\tgamma delta epsilon zeta ", "en", None),
    (3, None, None, "s1"),
    (4, "", "de", "s2"),
    (5, " \n\t\x0b\x0c\r", "de", ""),
    (None, "alpha beta gamma delta epsilon zeta", None, None),
    (None, None, None, None),
    (6, "\x01 marked \x02 by \x01 control", "fr", "s2"),
    (7, "é ü \U0001f600 über alles hinaus und weiter", "de", "s2"),
    (8, "word " * 30_000, "en", "s1"),
    (9, "x" * 200_000, "en", "s3"),
    (10, "Alpha Beta Gamma Delta Epsilon Zeta", "en", "s3"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge cases with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, src, None, 1, 1, "n", "d", "w", True, 5, 0) for i, t, lang, src in EDGE], WIDE)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], WIDE)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def collected(df):
    return sorted(df.collect(), key=repr)
