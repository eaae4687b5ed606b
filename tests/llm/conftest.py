import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeated rows, and columns named as the operators name theirs."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, "the cat sat on the mat", "en", "a"), (1, "the cat sat on the mat", "en", "a"), (2, None, "en", None), (3, "", None, "a"), (None, "no id here at all", "en", "b"), (4, long, "en", "b"), (5, " \n\t ", None, None), (6, "ein kleiner hund läuft über die straße", "de", "b"), (7, "the cat sat on the mat", "en", "c"), (None, None, None, None)]
    extra = [f"{c} string" for c in ("rk", "row", "spans", "size", "taken", "h", "words", "id", "score", "part", "fp", "kept", "copies")]
    made = [(*r, len(r[1]) if r[1] is not None else None, *["x"] * len(extra)) for r in rows]
    return spark.createDataFrame(made, f"{COLUMNS}, {', '.join(extra)}")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
