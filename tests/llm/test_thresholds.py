"""Near-duplicates at thresholds other than 85 %."""

import random

import pytest

from corpusloom.llm import neardup


@pytest.mark.parametrize("percent, changed", [(70, 34), (80, 21)])
def test_pairs_at_the_threshold_are_linked(spark, percent, changed):
    rng = random.Random(percent)
    rows = []
    for i in range(40):  # of 196 shingles each, 196 - changed are shared
        words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        for j, more in ((0, changed), (1, changed), (2, changed + 8)):  # the last two are below the threshold with each other
            rows.append((3 * i + j, " ".join(words if j == 0 else words[: 200 - more] + [f"x{i}-{j}-{k}" for k in range(more)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert 100 * (196 - changed) >= percent * (196 + changed) and 100 * (196 - changed - 8) < percent * (196 + changed + 8)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, percent).collect()}
    assert got == {i: i if i % 3 == 2 else i - i % 3 for i, _ in rows}


def test_values_at_85_percent():
    assert neardup.band_rows(85) == neardup.ROWS
    assert neardup.likely(85) == pytest.approx(0.72, abs=1e-3)
    for percent in range(10, 100):
        r = neardup.band_rows(percent)
        assert (1 - (percent / 100) ** r) ** (neardup.ROWS * neardup.BANDS // r) <= neardup.MISSED
