import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t int, size string, key string, fp string, th string, word string, c string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, names the operators use themselves."""
    long = " ".join(f"w{i % 977} tail{i}" for i in range(30_000))
    extra = ("x", 1, "y", "k", "f", "h", "w", "c", "s")
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "a", 5),
        (1, "alpha beta gamma delta epsilon", "en", "a", 5),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \t\n\x0b ", "de", "b", 3),
        (None, "a text without an id that is long enough to have words", "fr", "b", 1),
        (None, None, None, None, None),
        (5, long, "en", "a", len(long)),
        (6, long + " one more", "en", None, 7),
        (7, "one", "xx", "c", 3),
    ]
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
