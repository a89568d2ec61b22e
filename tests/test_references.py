import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from polyad.operators import references
from polyad.operators.references import first_deliveries, life_intervals, orphan_counts, orphan_references, reference_counts, unsound_counts
from polyad.runtime import cut

DAY = datetime(2026, 1, 1)


def at(hours):
    return DAY + timedelta(hours=hours)


def brute(refs, log):
    bad = []
    for ref, key, t in refs:
        seen = [(a, gone) for k, a, gone in log if k == key and a is not None and a <= t]
        if not seen or max(seen)[1]:
            bad.append(ref)
    return sorted(bad)


@pytest.mark.parametrize("limit", [0, 10_000])
def test_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(references, "BROADCAST_ROWS", limit)
    rng = random.Random(limit)
    log = [(rng.choice([1, 1, 1, None, rng.randint(2, 300)]), rng.choice([None, at(rng.randint(0, 400))]), rng.random() < 0.4) for _ in range(600)]
    log += log[:40]
    refs = [(k, rng.choice([1, 1, 2, rng.randint(2, 350)]), at(rng.randint(-5, 420))) for k in range(1200)]
    logs = spark.createDataFrame(log, "key bigint, t timestamp, gone boolean")
    lives = life_intervals(logs, "key", F.col("gone"), "t")
    table = cut(spark.createDataFrame(refs, "ref bigint, key bigint, t timestamp"))
    assert sorted(r.ref for r in orphan_references(table, lives).collect()) == brute(refs, log)
    bad, months = set(brute(refs, log)), {ref: t.date().replace(day=1) for ref, _, t in refs}
    assert {r.period: r.n_orphans for r in orphan_counts(table, lives).collect()} == Counter(months[ref] for ref in bad)
    groups = unsound_counts(cut(reference_counts(table)), cut(lives)).collect()
    assert {r.heavy for r in groups} == {True, False} == {r.mixed for r in groups}


def test_life(spark):
    log = [(1, at(1), False), (1, at(2), False), (1, at(30), True), (1, at(30), False), (1, at(60), None), (2, at(1), True), (None, at(1), False), (3, None, False)]
    got = life_intervals(spark.createDataFrame(log, "key bigint, t timestamp, gone boolean"), "key", F.col("gone"), "t").collect()
    assert sorted((r.key, r.since, r.until) for r in got if r.until) == [(1, at(1), at(30))]
    assert [(r.key, r.since) for r in got if not r.until] == [(1, at(60))]


def test_first_deliveries_and_empty(spark):
    rows = [(1, at(5), 8, None), (1, at(4), 9, 2), (1, at(4), None, 3), (None, at(1), 1, 1), (2, None, 1, 1)]
    df = spark.createDataFrame(rows, "id bigint, seen timestamp, a bigint, ref bigint")
    assert [tuple(r) for r in first_deliveries(df, "id", "seen", ["a", "ref"]).select("a").collect()] == [(None,)]
    lives = life_intervals(spark.createDataFrame([], "key bigint, t timestamp, gone boolean"), "key", F.col("gone"), "t")
    refs = spark.createDataFrame([(1, 4, at(1)), (2, 4, at(2))], "ref bigint, key bigint, t timestamp")
    assert orphan_references(refs, lives).count() == 2
    assert orphan_references(refs.limit(0), lives).count() == 0 and orphan_counts(refs.limit(0), lives).count() == 0
