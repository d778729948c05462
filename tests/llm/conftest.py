"""A small table of documents with the corners every operator has to bear."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, grp string, size string, start string, fingerprint string"


def make(spark, rows):
    """Documents from (doc_id, text, lang, source), with extra columns whose names clash with inner ones."""
    full = [(i, t, lang, s, None if t is None else len(t), "k", "g", "s", "x", "f") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long_text = " ".join(f"word{i % 977}x{i % 31}" for i in range(6000)) + "\nend."
    rows = [
        (5, None, "en", "a"), (1, "", None, None), (2, " \n\t ", "de", "a"), (3, "One two.\nOne two.\n", "en", "b"),
        (4, long_text, "en", "a"), (4, long_text, "en", "a"), (7, "tie", "fr", "b"), (7, "other tie", "fr", "b"),
        (None, "no id at all", "en", None), (None, None, None, None), (9, "a  b\r\nc\x00d é\U0001f600 <|endoftext|>", "en", "c"),
    ]
    return make(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
