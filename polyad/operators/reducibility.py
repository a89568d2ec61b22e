"""Which sizes of edges a hypergraph can do without: description lengths of its layers of sizes.

Spark counts the subsets that layers cover; what remains is arithmetic on one number per pair of sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from itertools import chain, combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.functions.columns import log_choose
from polyad.operators.edges import node_table
from polyad.operators.projections import subsets_of_size
from polyad.runtime import cut

#: Layers up to which all subsets of layers are tried.
EXACT_LAYERS = 16


def _log_binomial_of(log_n: float, n: float, k: float) -> float:
    """log of n over k where n may be too large for a float's factorial but k is small beside it."""
    if k <= 0:
        return 0.0
    if n < 1e15:
        return log_choose(n, k)
    return k * log_n - math.lgamma(k + 1)


def layer_costs(edges: DataFrame, nodes: DataFrame | None = None, *, method: str = "count") -> tuple[dict[int, float], dict[tuple[int, int], float]]:
    """Q_k = log C(C(N, k), E_k) of every size, and M_kl, the cost of layer l given layer k > l.

    ``count`` covers by the l-subsets of layer k's edges; ``project`` takes subsets step by step through
    the sizes in between that have edges, which gives the same sets.
    """
    if method not in ("count", "project"):
        raise InvalidParameterError("method is count or project")
    n = node_table(edges, nodes).count()
    layers = {r.size: r["count"] for r in edges.where("size >= 2").groupBy("size").count().collect()}  # a row per size
    sizes = sorted(layers)
    ways = {k: math.comb(n, k) for k in sizes}
    log_ways = {k: math.log(ways[k]) if ways[k] else 0.0 for k in sizes}
    q = {k: _log_binomial_of(log_ways[k], float(ways[k]) if ways[k] < 1e300 else math.inf, layers[k]) for k in sizes}
    m: dict[tuple[int, int], float] = {}
    for k in sizes:
        part = edges.where(F.col("size") == k).select("edge_id", "nodes")
        below = sorted((x for x in sizes if x < k), reverse=True)
        if method == "count" and below:
            # the subsets of all sizes in one table
            parts = [subsets_of_size(part, low).select(F.lit(low).alias("size"), F.col("part").alias("nodes")) for low in below]
            covered = cut(reduce(DataFrame.unionByName, parts).distinct())
            p_of = {r["size"]: r["count"] for r in covered.groupBy("size").count().collect()}
            hits = covered.join(edges.select("nodes"), "nodes", "left_semi").groupBy("size").count().collect()
            common_of = {r["size"]: r["count"] for r in hits}
        for low in below:
            if method == "project":
                covered = cut(subsets_of_size(part, low).select(F.col("part").alias("nodes")).distinct())
                p = covered.count()
                common = covered.join(edges.where(F.col("size") == low).select("nodes"), "nodes", "left_semi").count()
                part = covered.withColumn("edge_id", F.lit(0)).select("edge_id", "nodes")
            else:
                p, common = p_of[low], common_of.get(low, 0)
            rest = ways[low] - p
            m[k, low] = log_choose(p, common) + _log_binomial_of(math.log(rest) if rest > 0 else 0.0, float(rest), layers[low] - common)
    return q, m


def _length(chosen: Iterable[int], sizes: list[int], q: dict, m: dict) -> float:
    chosen = set(chosen)
    return sum(q[k] for k in chosen) + sum(min(m[k, low] for k in chosen if k > low) for low in sizes if low not in chosen)


def reducibility(edges: DataFrame, nodes: DataFrame | None = None, *, optimization: str = "exact", method: str = "count", costs: tuple[dict, dict] | None = None) -> tuple[float, tuple[int, ...]]:
    """eta and the representative sizes that describe the whole hypergraph in the shortest way.

    eta = (H0 - H*) / (H0 - Q_max), 1 if there is nothing to gain. ``exact`` tries all sets of layers that
    hold the largest size; ``greedy`` adds the layer that gains most until none does. ``costs`` are those of
    ``layer_costs``, if they are at hand.
    """
    q, m = costs or layer_costs(edges, nodes, method=method)
    sizes = sorted(q)
    if not sizes:
        raise InvalidParameterError("there are no edges of two or more nodes")
    top, others = sizes[-1], sizes[:-1]
    if optimization == "exact":
        if len(sizes) > EXACT_LAYERS:
            raise InvalidParameterError(f"exact search is for at most {EXACT_LAYERS} sizes; use greedy")
        options = chain.from_iterable(combinations(others, r) for r in range(len(others) + 1))
        best = min((tuple(sorted((*o, top))) for o in options), key=lambda c: (_length(c, sizes, q, m), len(c), c))
    elif optimization == "greedy":
        best = (top,)
        while True:
            options = [tuple(sorted((*best, x))) for x in others if x not in best]
            better = [c for c in options if _length(c, sizes, q, m) < _length(best, sizes, q, m) - 1e-12]
            if not better:
                break
            best = min(better, key=lambda c: (_length(c, sizes, q, m), c))
    else:
        raise InvalidParameterError("optimization is exact or greedy")
    h0, h = sum(q.values()), _length(best, sizes, q, m)
    return (1.0 if math.isclose(h0, q[top]) else (h0 - h) / (h0 - q[top])), best


def layer_reducibility(edges: DataFrame, nodes: DataFrame | None = None, *, method: str = "count", costs: tuple[dict, dict] | None = None) -> dict[int, float]:
    """Per size l, 1 - min over k > l of M_kl / Q_l; 0 for the largest, 1 where Q_l is 0."""
    q, m = costs or layer_costs(edges, nodes, method=method)
    top = max(q, default=None)
    return {low: 0.0 if low == top else 1.0 if q[low] == 0 else 1 - min(m[k, low] for k in q if k > low) / q[low] for low in sorted(q)}


def partition_costs(edges: DataFrame, blocks: DataFrame) -> tuple[dict[int, float], dict[tuple[int, int], float]]:
    """The same costs for edges seen through a partition of the nodes (``node``, ``block``).

    Edges become multisets of blocks: Q_k = log multichoose(C(b + k - 1, k), E_k), overlaps are sums of
    the lesser multiplicities.
    """
    b = blocks.select("block").distinct().count()
    coarse = edges.where("size >= 2").select("edge_id", "size", F.explode("nodes").alias("node")).join(blocks, "node")
    coarse = cut(coarse.groupBy("edge_id", "size").agg(F.array_sort(F.collect_list("block")).alias("nodes")))
    layers = {r.size: r["count"] for r in coarse.groupBy("size").count().collect()}  # a row per size
    sizes = sorted(layers)
    types = {k: math.comb(b + k - 1, k) for k in sizes}

    def multichoose(n: float, k: float) -> float:
        return log_choose(n + k - 1, k) if n > 0 else 0.0

    q = {k: multichoose(types[k], layers[k]) for k in sizes}
    m = {}
    for k in sizes:
        for low in (x for x in sizes if x < k):
            seen = subsets_of_size(coarse.where(F.col("size") == k), low).groupBy("part").agg(F.count("*").alias("n"))
            own = coarse.where(F.col("size") == low).groupBy(F.col("nodes").alias("part")).agg(F.count("*").alias("e"))
            p, common = seen.join(own, "part", "full").agg(F.sum(F.coalesce("n", F.lit(0))), F.sum(F.least(F.coalesce("n", F.lit(0)), F.coalesce("e", F.lit(0))))).first()
            m[k, low] = log_choose(p or 0, common or 0) + multichoose(types[low], layers[low] - (common or 0))
    return q, m
