import pytest

LONG = "the quick brown fox jumps over the lazy dog and then rests a while. " * 20_000


@pytest.fixture(scope="session")
def rough(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, and extra columns whose names clash."""
    rows = [
        (1, "One plain text about the sea, the wind and the boats.\nIt has a second line.", "en", "a", 74),
        (1, "One plain text about the sea, the wind and the boats.\nIt has a second line.", "en", "a", 74),
        (2, None, "en", "a", None),
        (3, "", "en", None, 0),
        (None, "A text without an identifier, of some words.", None, "b", 44),
        (4, " \n\t ", None, "b", 4),
        (5, LONG, "en", "b", len(LONG)),
        (6, "é" * 3000 + " \U0001f600 'tis 12 345 — don't", "fr", None, None),
        (7, "!!! ??? ...", "en", "a", 11),
    ]
    clash = ("x", 1, "y", None)
    return spark.createDataFrame(
        [r + clash for r in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, Text string, mix_slot int, predicted_lang string, n_words string",
    )


@pytest.fixture(scope="session")
def none(rough):
    return rough.limit(0)
