import random
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.llm import overlap
from polyad.llm.overlap import record_links, record_pairs, similar_between, similar_classes, similar_sets
from polyad.operators.records import member_records

SCHEMA = "edge_id bigint, interaction array<bigint>, class string, members int"


def sets_of(rows, least):
    found = {}
    for key, members, *_ in rows:
        if key is not None:
            found.setdefault(key, set()).update(x for x in members or [] if x is not None)
    return {k: v for k, v in found.items() if len(v) >= max(1, least)}


def close(a, b, t):
    return Fraction(len(a & b), len(a | b)) >= Fraction(t)


def made(rng, n, top):
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            base = list(rng.choice(rows)[1] or [])
            for _ in range(rng.randint(0, 3)):
                if base and rng.random() < 0.5:
                    base.pop(rng.randrange(len(base)))
                else:
                    base.append(rng.randint(1, 200))
            rng.shuffle(base)
        else:
            base = [rng.choice([1, 2, 3, 4, 5, rng.randint(1, 200)]) for _ in range(rng.randint(0, top))]
        rows.append((k, base + [None] * rng.randint(0, 1), "x", k))
    return rows


@pytest.mark.parametrize("common", [0, 8, 10_000])
@pytest.mark.parametrize(("threshold", "least", "small"), [("0.6", 6, 8), ("0.6", 1, 8), ("0.8", 1, 5), ("0.3", 1, 6), ("1", 2, 8)])
def test_against_brute_force(spark, threshold, least, small, common, monkeypatch):
    if common != 8 and small != 8:
        pytest.skip("both kinds of lists are tested at one size")
    monkeypatch.setattr(overlap, "COMMON", common)
    monkeypatch.setattr(overlap, "CLASS_BLOCK", 7)
    monkeypatch.setattr(overlap, "ROOM", 500)
    rows = made(random.Random(least + small), 220, 22)
    rows += [rows[3]] * 30 + [(900, None, None, 0), (None, [1, 2, 3], None, 0), (901, [None], None, 0), (902, list(range(60)), "", 1), (903, list(range(1, 62)), "", 1)]
    sets = sets_of(rows, least)
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if close(sets[a], sets[b], threshold)}
    records = member_records(spark.createDataFrame(rows, SCHEMA))
    classes, pairs = similar_sets(records, threshold=threshold, least=least, small=small)
    got = [tuple(r) for r in record_pairs(classes, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = {r.record: r.n_links for r in record_links(classes, pairs).collect()}
    assert links == {k: sum(k in p for p in want) for k in sets}
    for r in pairs.collect():
        assert r.class_a < r.class_b and r.n_common == len(sets[r.class_a] & sets[r.class_b])
    assert {r.record: r["class"] for r in classes.collect()} == {k: min(j for j, w in sets.items() if w == v) for k, v in sets.items()}


def test_very_large_sets(spark):
    """Sets of 20,000 values, of common values too, are found with a bounded number of keys at a time."""
    big = list(range(1000, 21_000))
    rows = [(1, big, "", 0), (2, big[:-3000], "", 0), (3, big[6000:], "", 0), (4, list(range(50)), "", 0)] + [(k, big[k : k + 9], "", 0) for k in range(5, 40)]
    sets = sets_of(rows, 6)
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if close(sets[a], sets[b], "0.6")}
    classes, pairs = similar_sets(member_records(spark.createDataFrame(rows, SCHEMA)), threshold="0.6", least=6)
    assert {tuple(r) for r in record_pairs(classes, pairs).collect()} == want > {(1, 2), (1, 3)}


def test_a_class_of_very_many_records(spark):
    """100,000 equal sets are one class: their links are counted without writing 5 * 10 ** 9 pairs."""
    rows = spark.range(100_000).selectExpr("id AS record", "sequence(1L, 9L) AS members").unionByName(spark.createDataFrame([(200_000, list(range(1, 9)))], "record bigint, members array<bigint>"))
    classes, pairs = similar_sets(rows, threshold="0.6", least=6)
    assert {(r["class"], r.n_links, r.n) for r in record_links(classes, pairs).groupBy("class", "n_links").agg(F.count("*").alias("n")).collect()} == {(0, 100_000, 100_000), (200_000, 100_000, 1)}
    assert overlap._blocks(classes).groupBy("class", "block").count().agg(F.max("count")).first()[0] < 2 * overlap.CLASS_BLOCK


def test_between_tables(spark):
    rng = random.Random(9)
    left, right = made(rng, 90, 12), made(rng, 90, 12)
    right += [(k, m, c, n) for k, m, c, n in left[:30]] + [(500, left[2][1], "", 0)]
    a, b = sets_of(left, 1), sets_of(right, 1)
    frames = [member_records(spark.createDataFrame(x, SCHEMA)) for x in (left, right)]
    got = [tuple(r) for r in similar_between(*frames, threshold="0.6").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(x, y) for x in a for y in b if close(a[x], b[y], "0.6")}


def test_empty_and_parameters(spark):
    empty = member_records(spark.createDataFrame([], SCHEMA))
    classes, pairs = similar_sets(empty, threshold="0.6")
    assert classes.count() == 0 and pairs.count() == 0
    with pytest.raises(InvalidParameterError):
        similar_classes(classes.withColumn("members", classes.record), threshold=0.0)
    with pytest.raises(InvalidParameterError):
        similar_sets(empty, threshold="0.05", small=3)
