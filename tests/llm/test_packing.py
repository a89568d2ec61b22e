import random
import time
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.llm.packing import Runs, _Left, dominating_set, lower_bound, pack, pack_documents, packing_report, plan
from polyad.llm.tokens import encoder


def contents(runs: Runs):
    bins = defaultdict(list)
    for size, first, n, at, per in zip(runs.size, runs.first, runs.n, runs.container, runs.per):
        for k in range(n):
            bins[at + k // per].append(size)
    return bins


def best(counts, capacity):
    """Fewest containers, by trying everything."""
    items = tuple(sorted(Counter(counts).elements(), reverse=True))

    @lru_cache(None)
    def go(rest, rooms):
        if not rest:
            return 0
        x, rest = rest[0], rest[1:]
        found = 1 + go(rest, tuple(sorted((*rooms, capacity - x))))
        for k in {r for r in rooms if r >= x}:
            left = list(rooms)
            left.remove(k)
            found = min(found, go(rest, tuple(sorted((*left, k - x)))))
        return found

    return go(items, ())


def test_plans_are_whole_and_close_to_the_best():
    rng, above = random.Random(1), 0
    for _ in range(150):
        capacity = rng.randint(3, 20)
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 9)))
        runs = plan(dict(counts), capacity)
        bins = contents(runs)
        assert Counter(x for b in bins.values() for x in b) == counts
        assert all(sum(b) <= capacity for b in bins.values()) and set(bins) == set(range(runs.containers))
        least = best(counts, capacity)
        assert -(-sum(s * n for s, n in counts.items()) // capacity) <= lower_bound(counts, capacity) <= least
        above += runs.containers - least
    assert above <= 3


def test_fixed_sets_are_part_of_a_best_packing():
    rng, fixed = random.Random(2), 0
    for _ in range(150):
        capacity = rng.randint(4, 24)
        counts = Counter(rng.randint(max(1, capacity // 5), capacity) for _ in range(rng.randint(2, 8)))
        for size in counts:
            left = _Left(dict(counts))
            found = dominating_set(left, size, capacity)
            assert dominating_set(left, size, capacity, left.pair_sums(capacity)) == found
            if found:
                fixed += 1
                assert sum(s * n for s, n in found.items()) <= capacity and found[size] and not found - counts
                assert best(counts - found, capacity) + 1 == best(counts, capacity)
    assert fixed > 100


def dominating(items, size, capacity):
    """The set that ``dominating_set`` is to find, by all pairs and triples of the other items."""
    others, room = sorted(items), capacity - size
    others.remove(size)
    best = max((x for x in others if x <= room), default=None)
    pairs = [p for p in combinations(others, 2) if sum(p) <= room]
    if best is None:
        return Counter([size])
    if best == room or not pairs or max(map(sum, pairs)) <= best and sum(others[:3]) > room:
        return Counter([size, best])
    if len(others) > 2 and sum(others[:3]) <= room:
        return None
    others.remove(best)
    third = max((x for x in others if x <= room - best), default=None)
    if third is None or any(min(p) > third and sum(p) > best for p in pairs):
        return None
    return Counter([size, best, third])


def test_dominating_sets_are_those_of_all_pairs():
    rng, kinds = random.Random(8), Counter()
    for _ in range(3000):
        capacity = rng.randint(4, 60)
        low = rng.randint(1, capacity // 3)
        items = [rng.randint(low, rng.randint(low, capacity)) for _ in range(rng.randint(1, 9))]
        left = _Left(Counter(items))
        for size in set(items):
            found = dominating_set(left, size, capacity, left.pair_sums(capacity))
            assert found == dominating(items, size, capacity), (items, size, capacity)
            kinds[found and found.total()] += 1
    assert min(kinds[k] for k in (None, 1, 2, 3)) > 100


def test_the_reduction_goes_on_to_its_end():
    """13,107 sizes, each of which has many partners: all containers are fixed, not the first few."""
    counts = dict.fromkeys(range(32_768, 45_875), 1)
    runs = plan(counts, 131_072)
    assert Counter(x for b in contents(runs).values() for x in b) == counts
    assert runs.fixed == runs.containers == 4369


def test_large_counts_are_few_runs():
    rng = random.Random(3)
    counts = {s: rng.randint(1, 10_000_000) for s in range(1, 171)}
    runs = plan(counts, 512)
    assert len(runs.size) < 10_000
    placed = Counter()
    for size, n in zip(runs.size, runs.n):
        placed[size] += n
    assert placed == counts
    assert runs.containers <= 1.01 * -(-sum(s * n for s, n in counts.items()) // 512)
    with pytest.raises(InvalidParameterError):
        plan({9: 1}, 8)


@pytest.mark.parametrize(("low", "high", "top"), [(0, 1, 1), (0, 1, 100), (0.25, 0.5, 1), (0.1, 0.8, 50)])
def test_many_sizes_are_planned_fast(low, high, top):
    rng, capacity = random.Random(6), 131_072
    every = range(max(1, int(low * capacity)), int(high * capacity))
    counts = {s: rng.randint(1, top) for s in rng.sample(every, min(100_000, len(every)))}
    began = time.process_time()
    runs = plan(counts, capacity)
    assert time.process_time() - began < 30  # a few seconds; a search of all sizes for each would take many minutes
    placed, used = Counter(), Counter()
    for size, n, at, per in zip(runs.size, runs.n, runs.container, runs.per):
        placed[size] += n
        for k in range(-(-n // per)):
            used[at + k] += size * min(per, n - k * per)
    assert placed == counts and max(used.values()) <= capacity and len(used) == runs.containers
    assert lower_bound(counts, capacity) <= runs.containers <= 1.12 * lower_bound(counts, capacity)


def test_grouped_input_is_packed_whole(spark):
    """A frame with a shuffle in it loses no item."""
    rows = spark.range(3000).select((F.col("id") % 1000).alias("item"), (F.col("id") % 37).alias("size")).groupBy("item").agg(F.max("size").alias("size"))
    found = pack(rows, 100)
    assert found.count() == 1000 and found.select("item").distinct().count() == 1000


def test_pack(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, 0, 3, 3, 3, 40, rng.randint(1, 60), 100, 205, 1000]), "x", 1) for k in range(700)] + [(5, 7, "", 2), (5, 7, "", 2), (None, 9, "", 3)]
    df = spark.createDataFrame(rows, "item bigint, size bigint, container string, part int").repartition(4)
    from polyad.runtime import cut

    found = pack(cut(df), 100).collect()
    used, parts = Counter(), defaultdict(list)
    for r in found:
        if r.container is not None:
            used[r.container] += r.size
        parts[r.item].append((r.part, r.size, r.container))
    assert max(used.values()) <= 100 and set(used) == set(range(len(used)))
    for k, size, *_ in rows[:700]:
        if k == 5:
            continue
        mine = sorted(parts[k])
        assert sum(x[1] for x in mine) == (size or 0) and [x[0] for x in mine] == list(range(len(mine)))
        assert len(mine) == 1 if (size or 0) <= 100 else len(mine) == -(-size // 100)
        assert (mine[0][2] is None) == (not size)
    assert len(parts[5]) == len([r for r in rows if r[0] == 5 and (r[1] or 0) <= 100]) + sum(-(-r[1] // 100) for r in rows if r[0] == 5 and (r[1] or 0) > 100)
    assert len(parts[None]) == 1
    assert len(used) <= 1.05 * sum(used.values()) / 100 + 1
    assert pack(df.limit(0), 100).collect() == []
    with pytest.raises(InvalidParameterError):
        pack(df, 0)


def test_pack_documents(spark):
    texts = ["a b c", None, "", "word " * 300, "x y"]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id bigint, text string, kind int").repartition(2)
    kinds = spark.createDataFrame([("small", 16, "byte_bpe_50k"), ("large", 64, "byte_bpe_multi_50k"), ("none", None, "byte_bpe_50k")], "container string, capacity bigint, tokenizer string")
    found = pack_documents(docs, kinds).collect()
    for kind, capacity, name in (("small", 16, "byte_bpe_50k"), ("large", 64, "byte_bpe_multi_50k")):
        for k, t in enumerate(texts):
            assert sum(r.n_tokens for r in found if r.kind == kind and r.doc_id == k) == encoder(name).count(t)
        assert all(r.n_tokens <= capacity for r in found if r.kind == kind)
    assert {r.kind for r in found} == {"small", "large"}
    for r in packing_report(docs, kinds).collect():
        mine = [x for x in found if x.kind == r.kind]
        assert r.n_tokens == sum(x.n_tokens for x in mine) and r.n_containers == len({x.container for x in mine} - {None}) >= r.n_least
        assert r.fill == pytest.approx(r.n_tokens / (r.n_containers * r.capacity))
