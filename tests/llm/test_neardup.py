import random
import re

from corpusloom.llm import components, neardup


def brute(rows, percent=85):
    """doc_id -> (set size, smallest doc_id reachable) by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {d: (n, r, d == r) for d, (n, r) in brute(rows).items()}


def edits(words, rate, rng):
    return [w if rng.random() > rate else f"new{rng.randrange(10**6)}" for w in words]


def test_equals_all_pairs_on_hot_groups(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(6):  # groups of near copies around the threshold, one of them large
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 300))]
        for _ in range(120 if g == 0 else 12):
            rows.append(" ".join(edits(base, rng.choice([0, 0.005, 0.012, 0.02, 0.04]), rng)))
    for _ in range(80):  # a passage in many texts that are not copies of each other
        own = [rng.choice(vocabulary) for _ in range(rng.randint(6, 30))]
        rows.append(" ".join(own + line))
    rows += ["Same  TEXT of\tsix words here", "same text of six words HERE", "one two", "One two", "two one", "", " \n", None, "É é", "é É"]
    rng.shuffle(rows)
    check(spark, [(i * 7 - 50, t) for i, t in enumerate(rows)])


def test_chain_of_links_is_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([f"x{j}" for j in range(8 * i)] + words[8 * i :])) for i in range(30)]
    rows = [(29 - i, t) for i, t in rows]
    check(spark, rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 700), (700, 600), (9, 9), (-5, 600), (201, 200)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 202)}, 500: -5, 600: -5, 700: -5}


def test_nulls_and_empty_tables(spark, docs, no_docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert len(got) == 11
    assert (None, 1, None, True) in got and (9, 0, 9, True) in got and (5, 9, 5, True) in got and (10, 9, 5, False) in got
    assert got.count((7, 1, 7, True)) == 2
    assert neardup.near_duplicates(no_docs).collect() == []


def test_unlike_texts_under_one_id_are_one_vertex(spark):
    x, y, z = ([f"{c}{i}" for i in range(60)] for c in "xyz")
    near = lambda words, k: " ".join([*words[:k], "other", *words[k + 1 :]])
    rows = [(1, " ".join(x)), (3, near(x, 59)), (2, " ".join(y)), (3, near(y, 59)), (5, " ".join(z)), (5, "short"), (6, " ".join(z)), (7, "Short"), (8, None), (8, near(z, 0)), (9, "alone"), (9, "alone again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert len(got) == len(rows) - 2  # the texts of 3, and those of 9, have sets of one size
    want = {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 9}
    assert {i: c for (i, _), (c, _) in got.items()} == want and all(k == (i == want[i]) for (i, _), (_, k) in got.items())


def test_hot_bucket_in_blocks_of_columns(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 50)
    test_equals_all_pairs_on_hot_groups(spark)
