import math
import random

import numpy as np
import pytest

from corpusloom.llm import knn


def brute(rows, every, k=5):
    vecs = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({i: v for i, v in vecs if i % every == 0}.items()):
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in vecs if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def check(spark, rows, every, **kw):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    assert sorted(tuple(r) for r in knn.top_k(df, f"id % {every} = 0", **kw).collect()) == brute(rows, every)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(knn, "QUERY_GROUP", 9)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "SLICE", 50)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(i, centres[0].tolist()) for i in range(300, 420)]  # one vector many times
    random.Random(seed).shuffle(rows)
    check(spark, rows, 5, pivots=12)


def clustered(rng, spread):
    centres = 4 * rng.normal(size=(16, 32))
    return [(i, (centres[i % 16] + spread * rng.normal(size=32)).tolist()) for i in range(1600)]


def test_bounds_save_copies_where_data_are_clustered(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_GROUP", 10)
    monkeypatch.setattr(knn, "SAMPLE", 60)
    rng = np.random.default_rng(3)
    share = {}
    for name, rows in (("close", clustered(rng, 0.02)), ("wide", clustered(rng, 0.3)), ("random", [(i, rng.normal(size=32).tolist()) for i in range(1600)])):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        share[name] = knn.plan(knn.integer_vectors(df), "id % 20 = 0", 5, 64, 32).share
        check(spark, rows[:700], 20, pivots=20)
    print(share)
    assert share["close"] < 0.3 and share["close"] < share["wide"] <= share["random"]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (5, None), (10, [None, 1.0]), (15, [float("nan"), 1.0]), (20, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows += [(25, [1.0]), (30, []), (1, [-0.001, 0.5]), (2, [1e12, -3e12]), (40, [1e12, 7e11]), (3, [0.0, 0.0])]
    check(spark, rows, 5)
    check(spark, [(7, [1.0])], 5)
    check(spark, [], 5)


def test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(spark, rows, 50)
