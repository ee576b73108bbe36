import pytest

# Awkward rows for every operator: nulls in any column, empty and blank texts, ties and repeated rows.
LONG = "word " * 30_000


@pytest.fixture
def documents(spark):
    """A small documents table from texts; ids count up from 0."""

    def make(*texts, **columns):
        rows = []
        for i, text in enumerate(texts):
            row = {"doc_id": i, "text": text, "lang": "en", "source": "s", "n_chars": len(text or "")}
            rows.append(row | {k: v[i] for k, v in columns.items()})
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        names = schema.replace(",", "").split()[::2]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    return make


@pytest.fixture
def odd_documents(spark):
    """Nulls in each column, an empty, a blank and a very long text, a repeated row, a clashing column."""
    rows = [
        (0, "The plain text of one document with some words in it.", "en", "a", 1, "x"),
        (1, None, "en", "a", None, None),
        (2, "", None, None, 0, "y"),
        (3, " \n\t ", "de", "b", 4, "y"),
        (None, "A text without an id but with a few words of its own here.", "en", "b", 9, "z"),
        (4, LONG, "en", None, 150_000, "z"),
        (5, "The plain text of one document with some words in it.", "fr", "a", 1, "x"),
        (6, "Twice the same row, word for word and column for column.", "en", "c", 7, "x"),
        (6, "Twice the same row, word for word and column for column.", "en", "c", 7, "x"),
        (7, "--- ... !!!", "en", "c", 11, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")
