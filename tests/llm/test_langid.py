import random

import numpy as np
import pytest

from corpusloom.llm import langid


def slow_cost(text, training):
    """Greedy phrases of the whole text by plain substring search; a letter unseen in training ends its phrase."""
    n, i = int(bool(text)), 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in training:
            j += 1
        n += j < len(text)
        i = j if j < len(text) and text[j] in training else j + 1
    return n


def test_phrases_equal_plain_search():
    rng = random.Random(1)
    training = {lang: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(300)) for lang, letters in (("aa", "abcd"), ("bb", "cdef"))}
    model = langid.build(training)
    texts = [" ".join("".join(rng.choice("abcdefxy") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (1, 5, 300)] + [training["bb"], "x", ""]
    got = langid.costs(model, texts)
    for t, row in zip(texts, got):
        for k, lang in enumerate(("aa", "bb")):
            assert round(row[k] / model.bits[k]) == slow_cost(t, training[lang]), (t, lang)
        assert row[2] == len(t)
    assert got[3, 1] < got[3, 0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    out = [r for r in got if r.held_out]
    import zlib

    assert {r.doc_id for r in out} == {i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    right = np.mean([rows[r.doc_id] == r.lang_pred for r in out])
    print("held-out accuracy", right, "all", np.mean([rows[r.doc_id] == r.lang_pred for r in got]))
    assert right >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_nulls_and_empty_tables(docs, no_docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[9].lang_pred == got[8].lang_pred == "und" and got[9].score == 0
    assert got[10].lang_pred == "en"
    assert langid.identify(no_docs).collect() == []
    assert {r.prediction.lang_pred for r in langid.predict(docs, langid.build({})).collect()} == {"und"}


@pytest.mark.parametrize("block, again", [(512, 3), (7, 3), (7, 0), (64, 1)])
def test_phrases_run_over_cuts(monkeypatch, block, again):
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "AGAIN", again)
    monkeypatch.setattr(langid, "LANES", 40)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    training = {"aa": " ".join(word() for _ in range(400)), "bb": "a" * 97 + " " + "ab" * 60}
    texts = [" ".join(word() for _ in range(n)) for n in (3, 700, 40, 2000)] + ["a" * 3000, "ab" * 900, training["aa"] * 2, "", "abcabz" * 300]
    for dense in (langid.DENSE_BYTES, 0):
        monkeypatch.setattr(langid, "DENSE_BYTES", dense)
        model = langid.build(training)
        for t, row in zip(texts, langid.costs(model, texts)):
            for k, lang in enumerate(("aa", "bb")):
                assert round(row[k] / model.bits[k]) == slow_cost(t, training[lang]), (t[:20], lang)


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "the text", 7, "x", 0.5, 1)], "doc_id long, text string, score int, lang_pred string, prediction double, row int")
    got = langid.predict(df, langid.build({"en": "the text of it", "de": "der und die"})).first()
    assert tuple(got)[:6] == (1, "the text", 7, "x", 0.5, 1) and got.prediction_.lang_pred == "en"


def test_many_languages_share_the_model(spark):
    rows = [(i, "ab cd " * 50 + f"l{i % 300}", f"l{i % 300}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, train_total=6000)
    assert len(model.langs) == 300 and len(model.table) < 60_000
