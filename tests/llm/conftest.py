"""Small documents for all operators: nulls in every column, empty and long texts, ties, repeated
rows, and columns named like the operators' own."""

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, kept int, score string, words string, n int"


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 7, "y", "z", 1)


@pytest.fixture(scope="session")
def frame(spark):
    def build(rows):
        return spark.createDataFrame([row(*r) for r in rows], DOCS)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    long = " ".join(f"word{i} token" for i in range(20_000))
    return [
        (1, None),
        (2, ""),
        (3, "   \n\t "),
        (4, long),
        (5, long),
        (None, "a null id"),
        (None, "a null id"),
        (7, "the same row"),
        (7, "the same row"),
        (8, "x" * 50_000),
        (9, "日本語 текст ελλά 😀     é"),
        (10, None, None, None),
    ]


@pytest.fixture(scope="session")
def odd(frame, odd_rows):
    return frame(odd_rows)


@pytest.fixture(scope="session")
def nothing(frame):
    return frame([])
