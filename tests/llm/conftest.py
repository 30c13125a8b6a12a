import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, epoch string"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of (doc_id, text[, lang, source]) with further columns whose names the operators use themselves."""

    def build(rows):
        full = [(*r, *(None, None)[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(*r[:4], None if r[1] is None else len(r[1]), "k", "s", "e") for r in full], SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [
        (1, None, "en", None),
        (2, "", None, "a"),
        (3, "  \n\t ", "en", "a"),
        (4, long, "en", "b"),
        (5, "one two three four five six", "de", "b"),
        (5, "one two three four five six", "de", "b"),
        (6, "one two three four five six", None, None),
        (None, "one two three four five six", "de", "a"),
        (None, None, None, None),
        (7, "Éa ñ 漢字 \U0001f600 x", "es", "é"),
        (8, "12345 !!!", "en", "b"),
    ]
    return docs(rows)
