"""Graphs of pairs from hypergraphs: bipartite, clique and line graphs, and the simplicial closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.operators.edges import node_table

#: Sizes up to which all subsets of an edge are listed (2 ** size of them).
MAX_CLOSED = 20


def bipartite(edges: DataFrame) -> DataFrame:
    """``edge_id`` and ``node``, the links of the bipartite graph of edges and nodes."""
    return edges.select("edge_id", F.explode("nodes").alias("node"))


def node_pairs(edges: DataFrame) -> DataFrame:
    """``edge_id``, ``a`` < ``b`` for every two nodes of an edge, made within the edge's row, without a join."""
    firsts = edges.where("size(nodes) > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("nodes") - 1)))
    return firsts.select("edge_id", "size", "weight", F.element_at("nodes", F.col("k")).alias("a"), F.explode(F.expr("slice(nodes, k + 1, size(nodes))")).alias("b"))


def clique(edges: DataFrame) -> DataFrame:
    """``a`` < ``b``, every two nodes with a common edge."""
    return node_pairs(edges).select("a", "b").distinct()


def clique_isolated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that the clique graph has no link for, to keep beside it."""
    return node_table(edges, nodes).join(node_pairs(edges).select(F.explode(F.array("a", "b")).alias("node")), "node", "left_anti")


def _distance(distance: str, n: Column, size_a: Column, size_b: Column) -> Column:
    if distance == "intersection":
        return n.cast("double")
    if distance == "jaccard":
        return n / (size_a + size_b - n)
    raise InvalidParameterError(f"unknown distance: {distance}")


def line_graph(edges: DataFrame, *, distance: str = "intersection", s: float = 1) -> DataFrame:
    """``edge_a`` < ``edge_b`` with a common node, and their weight ``w`` (common nodes, or Jaccard) >= ``s``.

    Pairs without a common node are never made, also with s = 0. Note that s = 1 with ``jaccard`` keeps
    equal edges only. The join is on the node; adaptive execution splits hubs.
    """
    held = edges.select("edge_id", F.size("nodes").alias("n"), F.explode("nodes").alias("node"))
    a, b = (held.select(F.col("edge_id").alias(f"edge_{x}"), F.col("n").alias(f"n_{x}"), "node") for x in "ab")
    met = a.join(b, "node").where("edge_a < edge_b").groupBy("edge_a", "edge_b").agg(F.count("*").alias("common"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return met.select("edge_a", "edge_b", _distance(distance, F.col("common"), F.col("n_a"), F.col("n_b")).alias("w")).where(F.col("w") >= s)


def directed_line_graph(edges: DataFrame, *, distance: str = "intersection", s: float = 1) -> DataFrame:
    """``edge_a``, ``edge_b`` and ``w``: how far the targets of the first are sources of the second, at least ``s``.

    ``s`` must be above 0: at 0 all pairs of edges would be linked.
    """
    if s <= 0:
        raise InvalidParameterError("s must be above 0")
    a = edges.select(F.col("edge_id").alias("edge_a"), F.size("tgt").alias("n_a"), F.explode("tgt").alias("node"))
    b = edges.select(F.col("edge_id").alias("edge_b"), F.size("src").alias("n_b"), F.explode("src").alias("node"))
    met = a.join(b, "node").where("edge_a != edge_b").groupBy("edge_a", "edge_b").agg(F.count("*").alias("common"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return met.select("edge_a", "edge_b", _distance(distance, F.col("common"), F.col("n_a"), F.col("n_b")).alias("w")).where(F.col("w") >= s)


def directed_line_degrees(edges: DataFrame, *, s: int = 1) -> DataFrame:
    """``edge_a`` and ``n_edges``: how many other edges ``directed_line_graph`` links it with, by intersection; edges without any are left out.

    Edges with the same targets or the same sources are alike, so different sets meet, with the number of their
    edges, and the links themselves are never made.
    """
    if s <= 0:
        raise InvalidParameterError("s must be above 0")
    a = edges.select("tgt").distinct().select("tgt", F.explode("tgt").alias("node"))
    b = edges.groupBy("src").agg(F.count("*").alias("n")).select("src", "n", F.explode("src").alias("node"))
    met = a.join(b, "node").groupBy("tgt", "src").agg(F.count("*").alias("common"), F.first("n").alias("n")).where(F.col("common") >= s)
    own = (F.size(F.array_intersect("tgt", "src")) >= s).cast("bigint")
    counted = edges.select("edge_id", "tgt", own.alias("own")).join(met.groupBy("tgt").agg(F.sum("n").alias("n")), "tgt")
    return counted.select(F.col("edge_id").alias("edge_a"), (F.col("n") - F.col("own")).alias("n_edges")).where("n_edges > 0")


def subsets_of_size(edges: DataFrame, k: int, *, column: str = "nodes") -> DataFrame:
    """``edge_id`` and ``part``: every subset of ``k`` nodes of every edge, in the edge's order.

    Grown one node at a time in the rows themselves, so an edge's subsets never form one array.
    """
    if k < 1:
        raise InvalidParameterError("subsets need at least one node")
    empty = F.array().cast(edges.schema[column].dataType)
    grown = edges.where(F.size(column) >= k).select("edge_id", F.col(column).alias("of"), F.lit(0).alias("at"), empty.alias("part"))
    for left in range(k, 0, -1):
        grown = grown.withColumn("next", F.explode(F.sequence(F.col("at") + 1, F.size("of") - (left - 1))))
        grown = grown.select("edge_id", "of", F.col("next").alias("at"), F.concat("part", F.array(F.element_at("of", F.col("next")))).alias("part"))
    return grown.select("edge_id", "part")


def simplicial_complex(edges: DataFrame, *, max_size: int = MAX_CLOSED) -> DataFrame:
    """``nodes``: every subset of every edge once, the empty one and single nodes included.

    An edge of more than ``max_size`` nodes is an error, for its subsets can't be listed.
    """
    if max_size > MAX_CLOSED:
        raise InvalidParameterError(f"at most {MAX_CLOSED} nodes can be closed")
    checked = edges.withColumn("nodes", F.when(F.size("nodes") <= max_size, F.col("nodes")).otherwise(F.raise_error(F.lit(f"an edge has more than {max_size} nodes"))))
    kind = edges.schema["nodes"].dataType
    masks = F.explode(F.expr("sequence(0L, shiftleft(1L, size(nodes)) - 1)"))
    parts = checked.select("nodes", masks.alias("mask")).select(F.expr("filter(nodes, (x, i) -> (shiftright(mask, i) & 1) = 1)").cast(kind).alias("nodes"))
    return parts.distinct()


def edge_labels(edges: DataFrame) -> DataFrame:
    """``edge_id`` and the edge's nodes as text."""
    return edges.select("edge_id", F.array_join(F.col("nodes").cast("array<string>"), "|").alias("edge"))


def with_labels(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of edges with the edges' nodes as text instead of ids."""
    names = edge_labels(edges)
    for x in "ab":
        pairs = pairs.join(names.select(F.col("edge_id").alias(f"edge_{x}"), F.col("edge").alias(f"name_{x}")), f"edge_{x}")
    return pairs.drop("edge_a", "edge_b").withColumnsRenamed({"name_a": "edge_a", "name_b": "edge_b"})
