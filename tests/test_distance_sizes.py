"""Distances of the pairs of edges that are wanted, without those of all pairs."""

import random

from polyad import Hypergraph
from polyad.operators import correlation as R


def test_pair_distances(spark):
    rng = random.Random(4)
    some = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(30)} | {(50, 51, 52), (52, 53)} | {(k, k + 1) for k in range(60, 70)}
    g = Hypergraph.from_edges(spark, sorted(some)).cached()
    every = {(r.edge_a, r.edge_b): r.distance for r in R.edge_distances(g.edges).collect()}
    ids = [r.edge_id for r in g.edges.collect()]
    pairs = [(a, b) for a in ids for b in ids if rng.random() < 0.5]
    found = R.pair_distances(g.edges, spark.createDataFrame(pairs, "edge_a bigint, edge_b bigint"))
    assert {(r.edge_a, r.edge_b): r.distance for r in found.collect()} == {p: every[p] for p in pairs if p in every} and max(every.values()) >= 9
