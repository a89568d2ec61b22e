"""What ended beyond a size, or made all pairs on its way, and now does not."""

import random
from collections import Counter

from polyad import Hypergraph
from polyad.operators import projections as J


def arcs(seed, n_nodes, n_edges):
    rng = random.Random(seed)
    return sorted({(tuple(sorted(rng.sample(range(n_nodes), rng.choice((1, 2, 3))))), tuple(sorted(rng.sample(range(n_nodes), rng.choice((1, 2)))))) for _ in range(n_edges)})


def test_directed_line_degrees(spark):
    g = Hypergraph.from_edges(spark, arcs(5, 9, 120), kind="directed").cached()
    for s in (1, 2):
        links = Counter(r.edge_a for r in J.directed_line_graph(g.edges, s=s).collect())
        assert {r.edge_a: r.n_edges for r in J.directed_line_degrees(g.edges, s=s).collect()} == links
    # no row per pair of edges on the way
    plan = J.directed_line_degrees(g.edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "edge_b" not in plan
