"""Closeness of many edges of few nodes."""

import pytest

from polyad import Hypergraph
from polyad.operators import paths as P
from tests.test_node_closeness_sizes import made


def test_edge_closeness_of_any_number_of_edges(spark, monkeypatch):
    g = Hypergraph.from_edges(spark, made(1, 12, 14) + made(2, 5, 6, 20)).cached()
    old = {r.edge_id: r.closeness for r in P.edge_path_scores(g.edges, "closeness").collect()}
    for name in ("OVERLAP_EDGES", "DENSE_EDGES", "ALL_PAIRS"):
        monkeypatch.setattr(P, name, 3)
    assert {r.edge_id: r.closeness for r in P.edge_path_scores(g.edges, "closeness").collect()} == pytest.approx(old)
