"""Closeness of few nodes among many edges."""

import random

import pytest

from polyad import Hypergraph
from polyad.operators import paths as P


def made(seed, n_nodes, n_edges, start=0):
    rng = random.Random(seed)
    return sorted({tuple(sorted(start + x for x in rng.sample(range(n_nodes), rng.choice((1, 2, 3))))) for _ in range(n_edges)})


def test_node_closeness_of_any_number_of_edges(spark, monkeypatch):
    g = Hypergraph.from_edges(spark, made(1, 12, 14) + made(2, 5, 6, 20)).cached()
    few = {r.node: r.closeness for r in P.node_path_scores(g.edges, "closeness").collect()}
    monkeypatch.setattr(P, "DENSE_NODES", 3)
    assert few == pytest.approx({r.node: r.closeness for r in P.node_path_scores(g.edges, "closeness").collect()})
    monkeypatch.setattr(P, "DENSE_NODES", 128)
    monkeypatch.setattr(P, "DENSE_EDGES", 3)
    assert few == {r.node: r.closeness for r in P.node_path_scores(g.edges, "closeness").collect()}
