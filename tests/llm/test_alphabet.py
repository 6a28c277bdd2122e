"""Language ID with more letters than one table holds."""

import random

import pytest

from corpusloom.llm import langid
from tests.llm.test_langid import slow_cost


def words(rng, first, n, size=700):
    """Words of a vocabulary of 300, the same for the same letters."""
    own = random.Random(first)
    vocabulary = ["".join(chr(first + own.randrange(size)) for _ in range(own.randint(1, 6))) for _ in range(300)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def test_every_letter_of_the_training_texts_counts():
    rng = random.Random(4)
    training = {lang: words(rng, first, 700) for lang, first in (("aa", 0x4E00), ("bb", 0x5400), ("cc", 0xAC00), ("dd", 0x6000))}
    model = langid.build(training)
    assert model.width > 256 and set(model.codes) == {ord(c) for t in training.values() for c in t if c != " "}
    texts = [words(rng, first, n) for first in (0x4E00, 0x5400, 0xAC00, 0x6000) for n in (2, 30, 400)] + [training["cc"], "\u4e00 q \u9f00", "x", ""]
    got = langid.costs(model, texts)
    for t, row in zip(texts, got):
        for k, lang in enumerate(sorted(training)):
            assert round(row[k] / model.bits[k]) == slow_cost(t, training[lang]), (t, lang)
    assert got[:12, :4].argmin(1).tolist() == [k for k in range(4) for _ in range(3)]


def test_lookups_equal_the_table(monkeypatch):
    rng = random.Random(5)
    training = {lang: words(rng, first, 200, 20) for lang, first in (("aa", 97), ("bb", 100))}
    texts = [words(rng, 95, n, 30).lower() for n in (1, 9, 500)] + ["", training["aa"]]
    table = langid.costs(langid.build(training), texts)
    monkeypatch.setattr(langid, "DENSE_BYTES", 0)
    assert langid.costs(langid.build(training), texts) == pytest.approx(table)
