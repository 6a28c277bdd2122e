"""Builds that stop and go on, generation logs and the checks before their rows are used."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import allocation as A
from corpusloom.streaming import builds as B
from corpusloom.streaming import genlog as G


def rows(spark, **sizes):
    return spark.createDataFrame([(s, i, n) for s, own in sizes.items() for i, n in enumerate(own)], "source string, ord long, n_tokens long")


def targets(spark, identity="v1", **of):
    return spark.createDataFrame([(s, identity, t) for s, t in of.items()], "source string, identity string, target long")


def test_builds_go_on_where_they_stopped(spark, tmp_path):
    data, at = rows(spark, a=[10] * 40, b=[7] * 3), f"file://{tmp_path}/b"
    first = {r.source: (r.cursor, r.unique_tokens, r.exhausted) for r in B.build(data, targets(spark, a=95, b=95), at).collect()}
    assert first == {"a": (9, 100, False), "b": (2, 21, True)}
    second = {r.source: (r.cursor, r.unique_tokens, r.round) for r in B.build(data, targets(spark, a=201, b=300), at).collect()}
    assert second == {"a": (20, 210, 1), "b": (2, 21, 0)}
    third = {r.source: r.cursor for r in B.build(data, targets(spark, a=400), at, limit_docs=3).collect()}
    assert third == {"a": 23, "b": 2}
    got = sorted((r.source, r.ord) for r in B.built(spark, at).collect())
    assert got == [("a", i) for i in range(24)] + [("b", i) for i in range(3)]


def test_rows_without_a_state_do_not_count(spark, tmp_path):
    data, at = rows(spark, a=[10] * 40), f"file://{tmp_path}/b"
    B.build(data, targets(spark, a=50), at)
    data.where("ord >= 5").write.parquet(f"{at}/rows/round=1")  # a build that was killed before its state
    assert B.built(spark, at).count() == 5
    B.build(data, targets(spark, a=70), at)
    assert sorted(r.ord for r in B.built(spark, at).collect()) == list(range(7))


def test_changed_sources_are_refused(spark, tmp_path):
    data, at = rows(spark, a=[10] * 40), f"file://{tmp_path}/b"
    B.build(data, targets(spark, a=50), at)
    with pytest.raises(B.Refused):
        B.build(data, targets(spark, "v2", a=90), at)


def test_rounds_end_or_say_that_more_is_needed(spark, tmp_path):
    data = rows(spark, a=[10] * 10, b=[10] * 100, c=[10] * 100)
    shares = spark.createDataFrame([("a", 0, 0.5, "v"), ("b", 1, 0.25, "v"), ("c", 2, 0.25, "v")], "source string, position int, share double, identity string")
    got = {r.source: (r.tokens, r.unique_tokens, r.exhausted) for r in B.run_rounds(data, shares, 1000, f"file://{tmp_path}/a").collect()}
    assert got == {"a": (100, 100, True), "b": (450, 450, False), "c": (450, 450, False)}
    with pytest.raises(B.NeedMore):
        B.run_rounds(data, shares, 1000, f"file://{tmp_path}/b", rounds=1)


def test_largest_feasible_total(spark):
    import random

    rng = random.Random(3)
    for _ in range(8):
        n = rng.randint(1, 5)
        live = [rng.random() < 0.5 for _ in range(n)]
        share = [rng.randint(1, 9) for _ in range(n)]
        state = [(f"s{i}", share[i] / sum(share), rng.randint(0, 50), 0, not live[i]) for i in range(n)]
        df = spark.createDataFrame(state, "source string, share double, unique_tokens long, consumed long, exhausted boolean")
        got = A.largest_feasible(df, 2).first()[0]

        def fits(total):
            """Water-filling leaves no live source above its unique tokens, and gives out all."""
            left, active, given = float(total), list(range(n)), {}
            while active:
                w = sum(state[i][1] for i in active)
                full = [i for i in active if state[i][4] and left * state[i][1] / w > 2 * state[i][2]]
                if not full:
                    given.update({i: left * state[i][1] / w for i in active})
                    left = 0.0
                    break
                for i in full:
                    given[i] = 2.0 * state[i][2]
                left = max(0.0, left - sum(given[i] for i in full))
                active = [i for i in active if i not in full]
            return left < 1e-6 and all(state[i][4] or given.get(i, 0) <= state[i][2] + 1e-6 for i in range(n))

        assert fits(got) and not fits(got + 2), state


def test_logs_with_torn_tails(spark, tmp_path):
    lines = ['{"id": "a", "response": "1", "teacher": "t", "revision": "r", "tag": "x"}', "", '{"id": "b"}', '{"id": "a", "response": "2", "teacher": "t", "revision": "r", "tag": "x"}', '{"id": "b"}', '{"id": "c", "resp']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = G.read_log(spark, f"file://{tmp_path}/log.jsonl")
    assert {r.id: r.response for r in G.last_answers(log).collect()} == {"a": "2", "b": None}
    ids = spark.createDataFrame([(i,) for i in "abc"], "id string")
    assert {(r.id, r.tries) for r in G.to_do(ids, log).collect()} == {("b", 2), ("c", 0)}
    assert {r.id for r in G.to_do(ids, log, attempts=2).collect()} == {"c"}
    prompts = spark.createDataFrame([("a", "p")], "id string, prompt string")
    kept = spark.createDataFrame([("a", True, "x"), ("b", False, "x")], "id string, kept boolean, tag string")
    assert [(r.id, r.prompt, r.response) for r in G.kept_rows(kept, log, prompts).collect()] == [("a", "p", "1")]
    with pytest.raises(G.Integrity):
        G.kept_rows(kept.withColumn("tag", F.lit("y")), log, prompts)
    assert G.check_inputs("d", None, 1.0, 1.0, kept, log) == ("t", "r")
    for bad in (("d", "e", 1.0, 2.0), ("d", "d", 3.0, 2.0)):
        with pytest.raises(G.Integrity):
            G.check_inputs(*bad, kept, log)
    two = log.withColumn("teacher", F.col("line").cast("string"))
    with pytest.raises(G.Integrity):
        G.check_inputs("d", None, 1.0, 1.0, kept, two)
