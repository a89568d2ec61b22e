"""Rounds on arrays for as many incidences as the driver can hold, against the rounds on tables."""

import random

import numpy as np
import pytest

from polyad import Hypergraph
from polyad.operators import centrality as C


def test_tensor_rounds_by_columns():
    rng = np.random.default_rng(1)
    node = np.array([rng.choice(9, 4, replace=False) for _ in range(30)]).ravel()
    x = rng.random(9)
    wanted = np.zeros(9)
    for e in node.reshape(-1, 4):
        for i in range(4):
            wanted[e[i]] += np.prod([x[j] for j in e if j != e[i]])
    assert C._tensor_on_arrays(node, 4, 1.0)(x, None, node) == pytest.approx(wanted)
    assert C._tensor_on_arrays(node, 4, 0.5)(x, None, node) == pytest.approx(np.sqrt(wanted))


def test_held_centrality_names_its_nodes(spark, monkeypatch):
    rng = random.Random(2)
    g = Hypergraph.from_edges(spark, sorted({tuple(sorted(rng.sample("abcdefghi", 3))) for _ in range(25)})).cached()
    held = {r.node: r.centrality for r in C.z_centrality(g.edges, seed=3).collect()}
    assert C.HELD_INCIDENCES >= 5_400_000
    monkeypatch.setattr(C, "HELD_INCIDENCES", 0)
    assert held == pytest.approx({r.node: r.centrality for r in C.z_centrality(g.edges, seed=3).collect()}, abs=1e-5)
