import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, n_words string, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing columns."""
    base = "the quick brown fox jumps over the lazy dog near the old river bank today while rain falls softly on green hills and small birds sing".split()
    long = " ".join(f"{w}{i % 97}" for i in range(400) for w in base)
    copy = " ".join(base * 3)
    rows = [
        (0, copy, "en", "a", 1), (1, copy, "en", "a", 1), (2, copy + " tail", "en", "b", 1), (3, None, None, None, None),
        (4, "", "en", "b", 0), (5, " \t\n\x0b ", "en", "b", 5), (6, long, "en", "c", 9), (6, long, "en", "c", 9),
        (7, "One line of shared text here\nOne line of shared text here\nunique seven", "en", None, 2),
        (8, "One line of shared text here\nunique eight", "en", None, 2), (9, "  ONE line of shared text here \n", "en", "c", 2),
        (None, "no id " + copy, "en", "d", 3), (10, "é ü \U0001f600 " + copy, "fr", "d", 3), (11, "word", None, "d", 1),
        (12, "don't  stop\xa0now 123 4,5!! <|endoftext|> 　x", "en", "d", 1), (13, "### $$$ %%% " * 30, "en", "e", 1),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
