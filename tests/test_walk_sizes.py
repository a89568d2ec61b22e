"""A random walk over many edges."""

from polyad import Hypergraph
from polyad.operators import dynamics as Y


def test_random_walk_makes_no_matrix(spark, monkeypatch):
    g = Hypergraph.from_edges(spark, [(0, 1, 2), (1, 2), (2, 3), (3, 4, 5)]).cached()
    steps = [tuple(Y.random_walk(g.edges, 0, 1, seed=k)) for k in range(30)]
    assert set(steps) == {(0, 1), (0, 2)}
    monkeypatch.setattr(Y, "transition_matrix", None)
    path = Y.random_walk(g.edges, 0, 12, seed=2)
    near = {(a, b) for e in [(0, 1, 2), (2, 3), (3, 4, 5)] for a in e for b in e if a != b}
    assert len(path) == 13 and set(zip(path, path[1:])) <= near
