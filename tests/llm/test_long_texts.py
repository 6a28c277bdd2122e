"""Texts of megabytes through the operators as they are queried."""

import hashlib
import random

import pytest

from corpusloom.llm import chat, fingerprints, langid, neardup, substrings


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(350_000))


@pytest.fixture
def long_docs(spark, long_text):
    return spark.createDataFrame([(1, long_text), (2, "short text of six words here"), (3, long_text + " and more")], "doc_id long, text string")


def test_fingerprints(long_docs, long_text):
    r = {x.doc_id: x for x in fingerprints.compare_with_edited(long_docs).collect()}
    # the text after 1 is that of 3, whose first half is that of 1, so the edited text is half of it twice
    assert r[1].n_chars == len(long_text) and r[1].near_next > 0.99 and 0.35 < r[1].near_edited < 0.65
    assert abs(r[1].shingles_estimate / 350_000 - 1) < 0.3


def test_near_duplicates_and_substrings(long_docs, long_text):
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(long_docs).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}
    left = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(long_docs).collect()}
    assert left[1][:2] == (0, 0) and left[3] == (len(long_text), 1, hashlib.sha256(b" and more").hexdigest())


def test_language_and_chat(spark, long_docs, long_text):
    model = langid.build({"xx": long_text[:20_000], "yy": "zzz qqq www " * 1000})
    assert {r.prediction.lang_pred for r in langid.predict(long_docs.where("doc_id <> 2"), model).collect()} == {"xx"}
    turns = spark.createDataFrame([(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", long_text)], "conv_id long, turn long, role string, text string")
    r = chat.digests(turns).first()
    assert r.loss_chars == len(long_text) and r.loss_sha256 == hashlib.sha256(long_text.encode()).hexdigest()
