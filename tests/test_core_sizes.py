"""Core-periphery of many edges."""

from polyad import Hypergraph
from polyad.operators import communities as K


def test_core_periphery_of_any_number_of_edges(spark, monkeypatch):
    g = Hypergraph.from_edges(spark, [(0, 1), (0, 1, 2), (0, 3), (1, 4), (0, 4, 5)], weights=[3, 2, 1, 1, 2]).cached()
    monkeypatch.setattr(K, "bounded_rows", None)
    found = {r.node: r.coreness for r in K.core_periphery(g.edges, rounds=200, seed=1).collect()}
    assert set(found) == set(range(6)) and max(found.values()) == found[0] == 1.0 and found[3] < found[1]
