import pytest

LONG = " ".join(f"word{i % 997} the of" for i in range(20_000))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns."""
    base = "the quick brown fox jumps over a lazy dog and runs to the river in the old town of stone near the hill"
    rows = [(1, base, "en", "s0", 10, "x"), (1, base, "en", "s0", 10, "x"), (2, base, "en", "s1", 10, "y"),
            (3, None, "en", "s0", None, None), (4, "", "fr", "s0", 0, None), (None, base + " again", None, None, 5, None),
            (5, LONG, "de", "s0", len(LONG), "z"), (6, " \n\t ", None, "s2", 4, None), (7, "un mot", "fr", "s1", 6, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    return spark.createDataFrame(rows, schema)
