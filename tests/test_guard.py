"""The guard against held-out replies: against all pairs of sets, and what it may shuffle."""

import random
import re

from corpusloom.operators import chatdata as C


def shingles(text):
    toks = re.findall(r"\w+|[^\w\s]", text or "")
    return {tuple(toks[i : i + 5]) for i in range(len(toks) - 4)} if len(toks) >= 5 else {tuple(toks)} if toks else set()


def replies():
    rng = random.Random(4)
    bases = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    texts = []
    for i in range(240):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.choice([0, len(words) - 1, rng.randrange(len(words))])] = f"new{i % 9}"
        texts.append((i % 97, rng.choice(["en", "de", None]), rng.choice([" ", "  "]).join(words)))
    return [*texts, (500, "en", ""), (501, "en", None), (502, "de", " ")]


def test_guard_equals_all_pairs(spark):
    rows = replies()
    train, test = rows[::2], [*rows[1::4], (900, "en", None)]
    want = {}
    for i, path, text in train:
        for _, other, t in test:
            a, b = shingles(text), shingles(t)
            if path is not None and path == other and 10 * len(a & b) >= 9 * len(a | b):
                want.setdefault(i, "near")
            if text is not None and t is not None and text.split() == t.split():
                want[i] = "whole"
    schema = "doc_id long, path string, text string"
    got = {r.doc_id: r.rule for r in C.split_guard(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema)).collect()}
    assert got == want and {"near", "whole"} <= set(want.values())


def test_guard_stages_few_shingles(spark, monkeypatch):
    """Of ten shingles about one is staged and shuffled; whole sets are made again for candidates only."""
    rng = random.Random(5)
    rows = [(i, "en", " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    made, staged = {}, C.staged
    monkeypatch.setattr(C, "staged", lambda rows, what: made.setdefault(what, staged(rows, what)))
    assert C.split_guard(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1")).collect() == []
    assert {len(r.s) for r in made["guard-rare"].collect()} == {396 - 357 + 1}
    assert made["guard-reps"].count() == 0
