import random
from collections import Counter

import numpy as np
import pytest

from polyad.errors import InvalidParameterError
from polyad.llm.frequent import frequent_items, merge_summaries, summarize_items

SCHEMA = "items array<bigint>, item string, n int, total string"


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = [([rng.choice([1, 2, 2, 3, None, rng.randint(10, 4000)]) for _ in range(rng.randint(0, 6))], "x", 1, None) for _ in range(n)]
    return rows + [(None, None, None, None), ([], "", 0, ""), ([None], "", 0, "")]


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_frequent(spark, parts):
    rows = rows_of(parts, 2500)
    counts = Counter(x for r in rows for x in r[0] or [] if x is not None)
    total = sum(counts.values())
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    found = {r.item: r for r in frequent_items(df, "items", share="0.05", counters=60).collect()}
    assert {k: r.n for k, r in found.items()} == {k: n for k, n in counts.items() if 20 * n >= total}
    for r in found.values():
        assert r.estimate >= r.n >= r.estimate - r.error and r.total == total and r.error <= total / 60


def test_summary_bounds(spark):
    rows = rows_of(8, 1500)
    counts = Counter(x for r in rows for x in r[0] or [] if x is not None)
    listed = summarize_items(spark.createDataFrame(rows, SCHEMA).repartition(7), "items", counters=30).collect()
    assert len(listed) == 30
    for r in listed:
        assert r.estimate >= counts[r.item] >= r.estimate - r.error
    left = set(counts) - {r.item for r in listed}
    assert max(counts[x] for x in left) <= listed[0].floor <= sum(counts.values()) / 30


def test_ties_at_the_threshold_and_empty(spark):
    rows = [([k % 4], "", 0, "") for k in range(100)]
    assert sorted(r.item for r in frequent_items(spark.createDataFrame(rows, SCHEMA), "items", share="0.25").collect()) == [0, 1, 2, 3]
    assert frequent_items(spark.createDataFrame([], SCHEMA), "items", share="0.01").collect() == []
    with pytest.raises(InvalidParameterError):
        frequent_items(spark.createDataFrame([], SCHEMA), "items", share="0.01", counters=50)


def test_merge_keeps_what_fits():
    items, estimates, errors, floor = merge_summaries(np.array([1, 2, 1]), np.array([5, 3, 4]), np.zeros(3, int), np.array([0, 0]), np.array([0, 0, 1]), 4)
    assert dict(zip(items, estimates)) == {1: 9, 2: 3} and not errors.any() and floor == 0
