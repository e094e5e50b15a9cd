import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, word string, piece int, start long, taken long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated
    rows, and extra columns whose names clash with the operators' own."""
    long_text = " ".join(f"wörd{i % 977} of  the tale\n" for i in range(30_000))
    same = "the same text stands here twice and it has more than five words"
    rows = [
        (None, "no id has this document but it has words", "en", "a", 1, None, None, None, None, None),
        (3, None, None, None, None, 1, "x", 1, 1, 1),
        (5, "", "en", "a", 0, 1, "x", 1, 1, 1),
        (7, " \n\t ", "en", None, 4, 1, "x", 1, 1, 1),
        (9, long_text, "en", "b", len(long_text), 1, "x", 1, 1, 1),
        (11, same, "en", "b", len(same), 1, "x", 1, 1, 1),
        (12, same, "en", "c", len(same), 1, "x", 1, 1, 1),
        (13, same.upper(), "en", "c", len(same), 1, "x", 1, 1, 1),
        (14, "Ünïcode ÉTÉ \U0001f600 <|endoftext|>  two blanks 🙂", "fr", "c", 1, 1, "x", 1, 1, 1),
        (14, "Ünïcode ÉTÉ \U0001f600 <|endoftext|>  two blanks 🙂", "fr", "c", 1, 1, "x", 1, 1, 1),
        (20, "a b " * 50, "de", "d", 1, 1, "x", 1, 1, 1),
        (20, "12345 !!! 678", "de", "d", 1, 1, "x", 1, 1, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
