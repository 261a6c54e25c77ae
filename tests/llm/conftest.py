import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty and long texts, copies, repeated rows and further columns."""
    rows = [(1, None, "a"), (2, "", "a"), (3, "one line that is long enough\nshort\none line that is long enough", None),
            (4, "One Line that is long enough \nother", "b"), (5, "\tone line that is LONG enough\nlast", "b"),
            (6, "é" * 30 + " don't  stop 12,5 it's\n\n x", "b"), (6, "é" * 30 + " don't  stop 12,5 it's\n\n x", "b"),
            (None, "no id\none line that is long enough", "c"), (7, "z" * 3000, "c"), (8, "word " * 4000, "c")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'x' AS _text", "1 AS pos")
