import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text[, ...]) as a table with the columns of `documents` and some of outputs' names."""

    def make(rows):
        full = [(i, t, *(rest or ["en", "src0"])) for i, t, *rest in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string")
        return df.selectExpr("*", "length(text) AS n_chars", "7 AS n_lines", "'x' AS Score", "1 AS _block", "2 AS _body")

    return make


#: Null and empty texts, a null id, rows alike, ids alike, a long text without a blank.
AWKWARD = [
    (1, None),
    (2, ""),
    (None, "the text of a row without an id"),
    (3, "one row that is here twice, word for word"),
    (3, "one row that is here twice, word for word"),
    (4, "first of two texts under an id"),
    (4, "second of two texts under an id"),
    (5, "x" * 70_000),
    (6, " \t\n \x0b\x0c\r"),
    (7, "ünï cödé \U0001f600 – text with\nlines\n\nand   blanks"),
]
