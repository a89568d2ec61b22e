import random
from collections import Counter
from itertools import combinations

import pytest

from polyad.errors import InvalidParameterError
from polyad.llm import cooccur
from polyad.llm.cooccur import pairs_together
from polyad.operators.records import member_records

SCHEMA = "edge_id bigint, interaction array<bigint>, record string, members int, item string"


def brute(rows, least):
    records = {}
    for key, members, *_ in rows:
        if key is not None:
            records.setdefault(key, set()).update(x for x in members or [] if x is not None)
    records = [r for r in records.values() if r]
    uses = Counter(x for r in records for x in r)
    both = Counter(p for r in records for p in combinations(sorted(r), 2))
    return {(a, b): (n, uses[a], uses[b], len(records)) for (a, b), n in both.items() if n >= least}


def run(spark, rows, least, **more):
    found = pairs_together(member_records(spark.createDataFrame(rows, SCHEMA)), min_count=least, **more).collect()
    assert all(abs(r.lift - r.n_both * r.n_records / (r.n_a * r.n_b)) < 1e-9 for r in found)
    got = {(r.item_a, r.item_b): (r.n_both, r.n_a, r.n_b, r.n_records) for r in found}
    assert len(got) == len(found)
    return got


@pytest.mark.parametrize("share", [1 / 512, 0.05, 1.0])
def test_against_brute_force(spark, share, monkeypatch):
    rng = random.Random(3)
    rows = [(k, [rng.choice([1, 1, 2, 3, rng.randint(4, 40), None]) for _ in range(rng.randint(0, 7))], "x", 1, None) for k in range(600)]
    rows += [rows[5]] * 50 + [(700, None, None, None, None), (None, [1, 2], None, None, None), (701, [None, None], "y", 2, "z")]
    rows += [(702, list(range(1, 45)), "wide", 0, None), (703, [2, 2], "one", 0, None)]
    monkeypatch.setattr(cooccur, "WIDE", 20)
    for least in (1, 4):
        assert run(spark, rows, least, heavy_share=share) == brute(rows, least)


def test_very_wide_record(spark):
    """50,000 members in one record: only those that other records have as well can be in a pair, and these are found."""
    rows = [(k, [k % 600, (k + 1) % 600, 100_000 + k % 3], None, None, None) for k in range(4000)] + [(9000 + k, list(range(50_000)), "wide", 0, None) for k in range(2)]
    found = run(spark, rows, 6)
    narrow = brute(rows[:4000], 1)
    want = {pair: (n + 2 * (pair[1] < 600), *_) for pair, (n, *_) in narrow.items() if n + 2 * (pair[1] < 600) >= 6}
    assert set(found) == set(want) and all(found[p][0] == want[p][0] for p in found)


def test_blocks_of_wide_records(spark, monkeypatch):
    """Every pair of a wide record comes out once, whatever the block."""
    rows = [(k, list(range(k * 7, k * 7 + 83 + k)), None, None, None) for k in range(4)]
    for width in (7, 41, 83, 500):
        monkeypatch.setattr(cooccur, "WIDE", width)
        assert run(spark, rows, 1, heavy_share=1.0) == brute(rows, 1)


def test_one_item_in_everything_and_empty(spark):
    rows = [(k, [0, k % 3 + 1], None, None, None) for k in range(90)]
    assert run(spark, rows, 12) == brute(rows, 12)
    assert run(spark, [], 1) == {}
    with pytest.raises(InvalidParameterError):
        run(spark, [], 0)
