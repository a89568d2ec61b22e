"""Correlations by the numbers of common nodes, against those by joins of all entries."""

import random

import pytest

from polyad import Hypergraph
from polyad.operators import correlation as R


def test_correlation_table_without_entries(spark, monkeypatch):
    rng = random.Random(3)
    events = [(rng.randrange(6), tuple(sorted(rng.sample(range(8), rng.choice((1, 2, 3, 4)))))) for _ in range(60)]
    edges = Hypergraph.from_edges(spark, events, kind="temporal").cached().edges
    entries = R._entry_sums
    monkeypatch.setattr(R, "_entry_sums", None)
    key = lambda r: (r.order_a, r.order_b, r.tau)
    found = {key(r): r.correlation for r in R.correlation_table(edges, 5, [0, 2, 3]).collect()}
    monkeypatch.setattr(R, "_entry_sums", entries)
    monkeypatch.setattr(R, "HELD_INCIDENCES", 0)
    joined = {key(r): r.correlation for r in R.correlation_table(edges, 5, [0, 2, 3]).collect()}
    assert len(found) == 75 and found == pytest.approx(joined) and found[5, 5, 0] == 0.0


def test_large_orders_end_at_zero():
    assert R._scaled(10**12, 1700, 1700, 5) == 0.0 and R._scaled(10, 3, 2, 5) == pytest.approx(1 / 6)
