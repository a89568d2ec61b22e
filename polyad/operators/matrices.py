"""Matrices of hypergraphs as rows (row, col, val); a product is a join and a sum.

Rows and columns are named by nodes and edge ids themselves, and zeros are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.operators.edges import by_size
from polyad.operators.projections import node_pairs


def _both_ways(pairs: DataFrame, *more: str) -> DataFrame:
    flipped = pairs.select(*more, F.col("col").alias("row"), F.col("row").alias("col"), "val")
    return pairs.select(*more, "row", "col", "val").unionByName(flipped)


def binary_incidence(edges: DataFrame, *, order: int | None = None) -> DataFrame:
    """``node``, ``edge_id``, ``val`` = 1."""
    return by_size(edges, order=order).select(F.explode("nodes").alias("node"), "edge_id", F.lit(1).cast("bigint").alias("val"))


def incidence(edges: DataFrame, *, order: int | None = None) -> DataFrame:
    """``node``, ``edge_id``, ``val`` = weight of the edge; of one order, or of all (then ``order`` tells them apart)."""
    rows = by_size(edges, order=order).select(F.explode("nodes").alias("node"), "edge_id", F.col("weight").alias("val"), (F.col("size") - 1).alias("order"))
    return rows


def adjacency(edges: DataFrame, *, weighted: bool = False, order: int | None = None) -> DataFrame:
    """``row``, ``col``, ``val``: in how many edges two nodes are together (``weighted``: the sum of squared weights); no diagonal."""
    val = F.sum(F.col("weight") * F.col("weight")) if weighted else F.count("*")
    pairs = node_pairs(by_size(edges, order=order)).groupBy(F.col("a").alias("row"), F.col("b").alias("col")).agg(val.alias("val"))
    return _both_ways(pairs)


def dual_adjacency(edges: DataFrame) -> DataFrame:
    """``row``, ``col`` (edge ids), ``val`` = 1 where two edges share a node; the diagonal is 1."""
    held = edges.select("edge_id", F.explode("nodes").alias("node"))
    a, b = (held.select(F.col("edge_id").alias(x), "node") for x in ("row", "col"))
    return a.join(b, "node").select("row", "col").distinct().withColumn("val", F.lit(1).cast("bigint"))


def degree_matrix(edges: DataFrame, order: int) -> DataFrame:
    """``row`` = ``col``, ``val`` = number of edges of the order; nodes without any are left out."""
    counted = by_size(edges, order=order).select(F.explode("nodes").alias("row")).groupBy("row").agg(F.count("*").cast("double").alias("val"))
    return counted.select("row", F.col("row").alias("col"), "val")


def laplacian(edges: DataFrame, order: int, *, weighted: bool = False) -> DataFrame:
    """L = (order + 1) D - I I' with the weighted incidence matrix I, times (order - 1)! if ``weighted``."""
    if order < 1:
        raise InvalidParameterError("the order of a Laplacian is at least 1")
    some = by_size(edges, order=order)
    factor = float(math.factorial(order - 1)) if weighted else 1.0
    held = some.select(F.explode("nodes").alias("row"), "weight").groupBy("row").agg(F.count("*").alias("n"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
    diagonal = held.select("row", F.col("row").alias("col"), ((order + 1) * F.col("n") - F.col("q")).alias("val"))
    off = adjacency(some, weighted=True).select("row", "col", (-F.col("val")).alias("val"))
    return diagonal.unionByName(off).select("row", "col", (F.col("val") * factor).alias("val"))


def laplacians(edges: DataFrame, max_order: int, *, weighted: bool = False) -> DataFrame:
    """Laplacians of the orders 1..max_order, with the column ``order``."""
    parts = [laplacian(edges, o, weighted=weighted).select(F.lit(o).alias("order"), "row", "col", "val") for o in range(1, max_order + 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def multiorder_laplacian(edges: DataFrame, sigmas: list[float], n_nodes: int, *, order_weighted: bool = False, degree_weighted: bool = True) -> DataFrame:
    """The sum over orders 1.. of sigma * L / mean degree (of all ``n_nodes`` nodes, without division if not ``degree_weighted``).

    An order without edges adds nothing.
    """
    if n_nodes < 1:
        raise InvalidParameterError("a Laplacian needs nodes")
    means = edges.groupBy((F.col("size") - 1).alias("order")).agg((F.sum("size") / n_nodes).alias("mean"))
    all_orders = laplacians(edges, len(sigmas), weighted=order_weighted).join(means, "order")
    sigma = F.element_at(F.array(*[F.lit(float(x)) for x in sigmas]), F.col("order"))
    scaled = sigma * F.col("val") / F.col("mean") if degree_weighted else sigma * F.col("val")
    return all_orders.groupBy("row", "col").agg(F.sum(scaled).alias("val"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product of two (row, col, val) tables."""
    left = a.select("row", F.col("col").alias("k"), F.col("val").alias("x"))
    right = b.select(F.col("row").alias("k"), "col", F.col("val").alias("y"))
    return left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("val"))


def commutator(a: DataFrame, b: DataFrame) -> DataFrame:
    """AB - BA where it isn't 0."""
    minus = product(b, a).select("row", "col", (-F.col("val")).alias("val"))
    return product(a, b).unionByName(minus).groupBy("row", "col").agg(F.sum("val").alias("val")).where("abs(val) > 1e-9")


def are_commuting(matrices: list[DataFrame]) -> bool:
    """Whether every two of the matrices commute: their commutator is 0."""
    return all(commutator(a, b).isEmpty() for k, a in enumerate(matrices) for b in matrices[k + 1 :])


def adjacency_tensor(edges: DataFrame, size: int) -> DataFrame:
    """``at`` (array of ``size`` nodes), ``val`` = 1 for every order of the nodes of every edge of a hypergraph of one size."""
    checked = edges.select(F.when(F.size("nodes") == size, F.col("nodes")).otherwise(F.raise_error(F.lit("the edges differ in size"))).alias("left"), F.array().cast(edges.schema["nodes"].dataType).alias("at"))
    for _ in range(size):
        checked = checked.select(F.explode("left").alias("next"), "left", "at").select(F.array_remove("left", F.col("next")).alias("left"), F.concat("at", F.array("next")).alias("at"))
    return checked.select("at", F.lit(1).cast("bigint").alias("val"))


def adjacency_factor(matrix: DataFrame, t: float = 0) -> DataFrame:
    """``node``, ``factor``: the sum of (entries rounded to 3 digits) ** t over the node's non-zero entries."""
    return matrix.where("val != 0").groupBy(F.col("row").alias("node")).agg(F.sum(F.pow(F.round("val", 3), F.lit(float(t)))).alias("factor"))


def temporal_adjacency(edges: DataFrame, *, order: int | None = None) -> DataFrame:
    """``time``, ``row``, ``col``, ``val``: the adjacency matrix of every time, with the nodes as global names."""
    some = by_size(edges, order=order).where("size(nodes) > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("nodes") - 1)))
    pairs = some.select("time", F.element_at("nodes", F.col("k")).alias("row"), F.explode(F.expr("slice(nodes, k + 1, size(nodes))")).alias("col"))
    return _both_ways(pairs.groupBy("time", "row", "col").agg(F.count("*").alias("val")), "time")


def annealed_adjacency(edges: DataFrame, *, order: int | None = None) -> DataFrame:
    """The mean of the adjacency matrices over all times that have an edge, symmetric."""
    times = edges.select("time").distinct().agg(F.count("*").alias("t"))
    summed = temporal_adjacency(edges, order=order).groupBy("row", "col").agg(F.sum("val").alias("val"))
    return summed.crossJoin(times).select("row", "col", (F.col("val") / F.col("t")).alias("val"))  # times is one row


def transition_matrix(edges: DataFrame) -> DataFrame:
    """Random walk: from a node to another in proportion to the sum of (size - 1) over their common edges; rows sum to 1."""
    pairs = node_pairs(edges).groupBy(F.col("a").alias("row"), F.col("b").alias("col")).agg(F.sum(F.col("size") - 1).cast("double").alias("val"))
    both = _both_ways(pairs)
    totals = both.groupBy("row").agg(F.sum("val").alias("total"))
    return both.join(totals, "row").select("row", "col", (F.col("val") / F.col("total")).alias("val"))


def normalized_rows(matrix: DataFrame) -> DataFrame:
    """Each row divided by its sum; rows that sum to 0 stay."""
    total = F.sum("val").over(Window.partitionBy("row"))
    return matrix.withColumn("total", total).select("row", "col", F.when(F.col("total") != 0, F.col("val") / F.col("total")).otherwise(F.col("val")).alias("val"))
