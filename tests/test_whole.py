"""Queries over the whole of their tables, without a part left out, against brute force on small tables."""

import re

import pytest

from corpusloom.plans import all_queries

QUERIES, _ = all_queries()
TEXTS = ["one two three", "Four, five!", "", "six\nseven  eight nine ten", None]


def tokens(text):
    return re.findall(r"\w+|[^\w\s]", text)


@pytest.fixture
def documents(spark, tmp_path):
    rows = [(i, TEXTS[i % 5], "abc"[i % 3], f"src{i % 4}", 10 + i) for i in range(1, 24)]
    rows += [(24 + i, None if i else "x y", "only_odd", "src1", 7) for i in (1, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def test_needles_are_planted_in_every_document(spark, documents):
    sf, rows = documents
    want = set()
    for doc_id, text, *_ in rows:
        for depth in (0, 25, 50, 100) if text is not None else ():
            at = len(tokens(text)) * depth // 100
            want.add((doc_id, depth, at, at // 256, len(tokens(text)) + 3))
    got = [tuple(r) for r in QUERIES["needle_planting"](spark, sf).where("total IS NOT NULL AND at IS NOT NULL").collect()]
    assert len(got) == len(want) and set(got) == want


def test_every_document_is_offered(spark, documents):
    sf, rows = documents
    offered = {}
    for _, _, lang, _, n in rows:
        offered[lang] = offered.get(lang, 0) + n
    total = sum(offered.values())
    want = {lang: (n, round(n * 250000 / total, 4), n * 250000 / total < 20000) for lang, n in offered.items()}
    got = {r.lang: (r.offered, float(r.projected), r.short) for r in QUERIES["projected_available"](spark, sf).collect()}
    assert got == want and "only_odd" in got


def test_texts_that_differ_late_are_no_duplicates(spark, tmp_path):
    same = "The same forty characters stand at the start of "
    texts = [same + "one", same + "two", "THE  same forty characters stand at the start of\none ", same + "one", "a\nline", "A line", "b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.status for r in QUERIES["two_key_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: "kept", 1: "kept", 2: "reply", 3: "sha", 4: "kept", 5: "reply", 6: "kept"}


def test_prompts_hold_whole_texts_of_every_document(spark, tmp_path):
    texts = ["short", "a\nb", " a text of far more than thirty characters\n\nin two parts ", "", "PROJECT TREE: x"]
    rows = [(i, t, f"l{i}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.step, r.tree) for r in QUERIES["prompt_sections"](spark, str(tmp_path)).collect()}
    assert got == {i: (t.strip(" "), lang) for i, t, lang in rows}


def test_every_benchmark_row_is_run(spark, tmp_path):
    spark.createDataFrame([(i, "x") for i in (0, 1, 2, 7, 10, 300)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.id: (r.passed, r.error) for r in QUERIES["sandboxed_tests"](spark, str(tmp_path)).collect()}
    assert got == {i: (False, "AssertionError") if i % 3 == 1 else (True, "") for i in (0, 1, 2, 7, 10, 300)}


def test_the_best_run_is_found_among_all_users(spark, tmp_path):
    rows = [(1, 10, "a", 4.0), (2, 10, "a", 6.0), (3, 10, "a", 2.0), (4, 700, "a", 1.0), (5, 700, "a", 3.5), (6, 55, "a", 2.0), (7, 9, "b", 3.0), (8, 90, "b", 2.0), (9, 90, "b", 20.0), (10, 70, "c", 1.5), (11, 8, "c", 2.0), (12, 8, "c", 2.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in QUERIES["sweep_decision"](spark, str(tmp_path)).select("event_type", "best", "loss", "noise", "decision").collect()}
    assert got == {("a", 700, 1.0, 2.5, "adopt"), ("b", 90, 2.0, 18.0, "unclear"), ("c", 70, 1.5, None, "unclear")}


def sized_documents(spark, at):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 11)), "en", f"src{i % 6}") for i in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    by = {}
    for i, text, _, source in rows:
        by.setdefault(source, []).append((i, len(tokens(text)) + 1))
    return by


def test_every_source_is_repeated(spark, tmp_path):
    want = set()
    for own in sized_documents(spark, tmp_path).values():
        start = 0
        for epoch in range(3):
            for doc_id, n in own:
                want.add((doc_id, epoch, start))
                start += n
    got = [tuple(r) for r in QUERIES["epoch_repeat"](spark, str(tmp_path)).select("doc_id", "epoch", "start").collect()]
    assert len(got) == len(want) and set(got) == want


def test_every_source_enters_the_mix(spark, tmp_path):
    by = sized_documents(spark, tmp_path)
    unique = {s: sum(n for _, n in own) for s, own in by.items()}
    got = QUERIES["deficit_interleave"](spark, str(tmp_path)).orderBy("place").collect()
    assert {r.source for r in got} == set(by)
    size = {i: n for own in by.values() for i, n in own}
    taken = {s: sum(size[r.doc_id] for r in got if r.source == s) for s in by}
    assert sum(unique.values()) <= sum(taken.values()) < sum(unique.values()) + max(size.values())
    assert all(taken[s] < 2 * unique[s] + max(size.values()) for s in by)
    for s, own in by.items():
        ids = [i for i, _ in own]
        assert [(r.doc_id, r.epoch) for r in got if r.source == s] == [(ids[k % len(ids)], k // len(ids)) for k in range(sum(r.source == s for r in got))]
