import hashlib
import random

import pytest

from corpusloom.llm import substrings


def brute(rows):
    """Results by comparing every window with all earlier ones; documents come by id and the SHA-256 of their text."""

    def place(doc_id, text):
        return doc_id, hashlib.sha256((text or "").encode()).hexdigest()

    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            here = (*place(doc_id, text), p)
            first[w] = min(first.get(w, here), here)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if first[raw[p : p + 100]] < (*place(doc_id, text), p):
                gone[p : p + 100] = b"\x01" * 100
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pos int")
    got = sorted(tuple(r) for r in substrings.digests(df).collect())
    assert got == brute(rows)


def some_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, line, passage = text(150), text(14), text(60)
    rows = [base, base, text(3), "", None, "a" * 350, "ab" * 200, "x" * 99, "x" * 100, "y" + "x" * 100]
    for _ in range(25):
        words = base.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = word()
        rows.append(" ".join(words))
    for _ in range(25):
        rows.append(text(rng.randint(5, 40)) + " " + rng.choice([line, passage, passage[: rng.randint(80, 140)]]) + " " + text(20))
    rows.append(passage + passage + text(30) + line + line)
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    check(spark, [(i * 3 - 20, t) for i, t in enumerate(some_rows(1))])


def test_distant_ids_and_small_slices(spark, monkeypatch):
    rows = some_rows(2)
    check(spark, [((i - 30) * 2**57, t) for i, t in enumerate(rows)])


def test_unlike_texts_under_one_id(spark):
    rows = [(i // 3, t) for i, t in enumerate(some_rows(6))]
    check(spark, rows + rows[:7])


def test_clashing_columns_are_kept(spark):
    rows = [(i // 2, t, i, -i, "a", "b", i) for i, t in enumerate(some_rows(7))]
    names = ["_base", "base", "_own", "row", "made"]
    df = spark.createDataFrame(rows, "doc_id long, text string, _base int, base int, _own string, row string, made int")
    got = sorted(tuple(r) for r in substrings.remove(df).select("doc_id", *names).collect())
    assert got == sorted((r[0], *r[2:]) for r in rows)


@pytest.mark.parametrize("group", substrings.ROUNDS)
def test_slices_do_not_matter(group, monkeypatch):
    import numpy as np

    text = (" ".join(some_rows(5)[i] or "" for i in range(60))).encode()

    def windows(slice_):
        monkeypatch.setattr(substrings, "_SLICE", slice_)
        out = {}
        for core, same, pos, n in substrings._rows([(1000, text, None), (900, b"q" * 150, np.array([[3, 20], [5, 1]]))], group):
            for c, p, k in zip(core, pos, n):
                out.update({int(q): int(c) for q in range(p, p + k)})
        return out

    a, b = windows(1 << 19), windows(700)
    assert a == b and len(a) == len(text) - 99 + 6


def test_remove_keeps_other_columns(spark):
    rows = [(i, t, f"s{i}") for i, t in enumerate(some_rows(4))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = substrings.remove(df).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted((i, s) for i, _, s in rows)
    sizes = {d: n - k for d, n, k, _, _ in brute([(i, t) for i, t, _ in rows])}
    assert all(len(r.text.encode()) <= sizes[r.doc_id] <= len(r.text.encode()) + 8 for r in got)


def test_nulls_and_empty_tables(spark, docs, no_docs):
    got = {(r.doc_id, r.n_bytes): r for r in substrings.digests(docs).collect()}
    assert got[None, 9].n_removed == 0 and got[9, 0].n_spans == 0
    assert got[3, 25000].n_removed == 25000 - 5 and got[3, 25000].n_spans == 1
    assert substrings.digests(no_docs).collect() == []
