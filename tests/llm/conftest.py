import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, blank and long texts, ties, repeated rows and a clashing extra column."""
    long = " ".join(f"w{k % 997} and{k}" for k in range(6000))
    base = "the quick brown fox jumps over the lazy dog and runs along the river bank until it finds a place to sleep in the warm evening sun"
    near = base.replace("river", "stream")
    rows = [
        (1, base, "en", "a", 5, "x"), (2, base, "en", "a", 5, "x"), (2, base, "en", "a", 5, "x"), (3, near, "en", "b", 5, None), (4, None, None, None, None, None),
        (5, "", "en", "b", 0, "y"), (6, " \t\n ", "en", None, 0, "y"), (None, base, "en", "b", 1, "z"), (7, long, "en", "c", 1, "z"), (8, "Word", "en", "c", 1, "z"),
        (9, "wörd ÉTÉ <|STARTOFTEXT|> <|endoftext|> don't STOP...", "fr", "c", 1, "z"), (10, "word", "en", "c", 1, "z"), (-3, "negative id here", "en", "c", 1, "z"), (2, "another text under a used id", "en", "a", 1, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
