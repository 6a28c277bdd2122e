import pytest

DOCS = [
    (10, "The cat sat on the mat, and the dog lay by the door."),
    (9, None),
    (8, ""),
    (7, "one two three"),
    (7, "one two three"),
    (5, "The cat sat on the mat, and the dog lay by the door."),
    (4, "naïve café 日本語  two spaces\n\n\tand tabs \x1c odd 'tis don't 12345 ..., x_y"),
    (3, "word " * 5000),
    (None, "a null id"),
    (1, "<|endoftext|> <|im_end|> ́ combining é"),
    (-2, " lead and trail "),
]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "s", 0, "clash", 1) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start string, n_tokens int")


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
