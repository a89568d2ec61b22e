"""Degrees, their distributions and correlations, and measures of directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.operators.edges import by_size, incidences, node_table


def degrees(edges: DataFrame, nodes: DataFrame | None = None, *, order: int | None = None, size: int | None = None) -> DataFrame:
    """``node`` and ``degree``, the number of its edges (of a size); nodes without any have 0."""
    held = by_size(edges, order=order, size=size).select(F.explode("nodes").alias("node"))
    counted = held.groupBy("node").agg(F.count("*").alias("degree"))
    if order is None and size is None and nodes is None:
        return counted
    return node_table(edges, nodes).join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_distribution(edges: DataFrame, nodes: DataFrame | None = None, *, order: int | None = None, size: int | None = None) -> DataFrame:
    """``degree`` and ``n_nodes``."""
    return degrees(edges, nodes, order=order, size=size).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def degree_correlation(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``size_a`` <= ``size_b`` and ``correlation``, Pearson's, of the nodes' degrees in edges of two sizes from 2 on.

    Computed from sums over the degrees that aren't 0; the nodes without an edge of a size enter by
    their number. Null where a size's degrees don't vary.
    """
    d = incidences(edges.where("size >= 2")).groupBy("node", "size").agg(F.count("*").cast("double").alias("d"))
    n = node_table(edges, nodes).agg(F.count("*").cast("double").alias("n"))
    own = d.groupBy("size").agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"))
    a, b = (d.select("node", F.col("size").alias(f"size_{x}"), F.col("d").alias(f"d_{x}")) for x in "ab")
    both = a.join(b, "node").where("size_a <= size_b").groupBy("size_a", "size_b").agg(F.sum(F.col("d_a") * F.col("d_b")).alias("p"))
    of_a, of_b = (own.select(F.col("size").alias(f"size_{x}"), F.col("s").alias(f"s_{x}"), F.col("q").alias(f"q_{x}")) for x in "ab")
    grid = of_a.join(of_b, F.col("size_a") <= F.col("size_b"))  # one row per pair of sizes
    all_pairs = grid.join(both, ["size_a", "size_b"], "left").crossJoin(n)  # n is one row
    cov = F.col("n") * F.coalesce("p", F.lit(0.0)) - F.col("s_a") * F.col("s_b")
    var = (F.col("n") * F.col("q_a") - F.col("s_a") ** 2) * (F.col("n") * F.col("q_b") - F.col("s_b") ** 2)
    return all_pairs.select("size_a", "size_b", F.when(var > 0, cov / F.sqrt(var)).alias("correlation"))


def side_degrees(edges: DataFrame, role: str, nodes: DataFrame | None = None, *, order: int | None = None, size: int | None = None) -> DataFrame:
    """``node`` and ``degree``, the number of directed edges in which it is ``source`` or ``target``."""
    if role not in ("source", "target"):
        raise InvalidParameterError("role is source or target")
    held = incidences(by_size(edges, order=order, size=size)).where(F.col("role") == role)
    counted = held.groupBy("node").agg(F.count("*").alias("degree"))
    return node_table(edges, nodes).join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def in_degrees(edges: DataFrame, nodes: DataFrame | None = None, **of: int) -> DataFrame:
    """Degrees as a target, as the graph's method counts them; ``source_side`` counts the other way."""
    return side_degrees(edges, "target", nodes, **of)


def out_degrees(edges: DataFrame, nodes: DataFrame | None = None, **of: int) -> DataFrame:
    """Degrees as a source, as the graph's method counts them."""
    return side_degrees(edges, "source", nodes, **of)


def source_side_degrees(edges: DataFrame, nodes: DataFrame | None = None, **of: int) -> DataFrame:
    """In-degrees as the plain functions define them: membership among the sources."""
    return side_degrees(edges, "source", nodes, **of)


def target_side_degrees(edges: DataFrame, nodes: DataFrame | None = None, **of: int) -> DataFrame:
    """Out-degrees as the plain functions define them: membership among the targets."""
    return side_degrees(edges, "target", nodes, **of)


def signature(edges: DataFrame, max_size: int | None = None) -> DataFrame:
    """``n_sources``, ``n_targets`` and ``n_edges`` for all combinations from 1 to max_size - 1, zeros included."""
    counted = edges.where("size(src) > 0 AND size(tgt) > 0").groupBy(F.size("src").alias("n_sources"), F.size("tgt").alias("n_targets")).agg(F.count("*").alias("n_edges"))
    if max_size is None:
        top = edges.agg((F.coalesce(F.max("size"), F.lit(1)) - 1).alias("top"))
    else:
        counted = counted.where(F.col("n_sources") + F.col("n_targets") <= max_size)
        top = edges.sparkSession.range(1).select(F.lit(max_size - 1).alias("top"))
    span = F.sequence(F.lit(1), F.col("top"))
    grid = top.where("top >= 1").select(F.explode(span).alias("n_sources"), "top").select("n_sources", F.explode(span).alias("n_targets"))
    return grid.join(counted, ["n_sources", "n_targets"], "left").select("n_sources", "n_targets", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def _share(edges: DataFrame, good: DataFrame, max_size: int) -> DataFrame:
    """Share of the edges of every size 2..max_size that are in ``good``; 0 for sizes without edges."""
    sizes = edges.sparkSession.range(2, max_size + 1).select(F.col("id").cast("int").alias("size"))
    marked = edges.select("edge_id", "size").join(good.select("edge_id").distinct().withColumn("good", F.lit(1)), "edge_id", "left")
    shares = marked.groupBy("size").agg((F.sum(F.coalesce("good", F.lit(0))) / F.count("*")).alias("reciprocity"))
    return sizes.join(shares, "size", "left").select("size", F.coalesce("reciprocity", F.lit(0.0)).alias("reciprocity"))


def exact_reciprocity(edges: DataFrame, max_size: int) -> DataFrame:
    """Per size, the share of edges whose reverse is an edge."""
    edges = edges.where(F.col("size") <= max_size)
    reverse = edges.select(F.col("src").alias("tgt"), F.col("tgt").alias("src"))
    return _share(edges, edges.join(reverse, ["src", "tgt"], "left_semi"), max_size)


def _arcs(edges: DataFrame) -> DataFrame:
    """Distinct (source, target) pairs of nodes over all edges."""
    return edges.select(F.explode("src").alias("s"), "tgt").select("s", F.explode("tgt").alias("t")).distinct()


def strong_reciprocity(edges: DataFrame, max_size: int) -> DataFrame:
    """Per size, the share of edges each of whose sources is a target of some edge that has one of its targets as a source."""
    edges = edges.where(F.col("size") <= max_size)
    need = edges.select("edge_id", F.explode("src").alias("t"), "tgt").select("edge_id", "t", F.explode("tgt").alias("s"))
    met = need.join(_arcs(edges), ["s", "t"], "left_semi").select("edge_id", "t").distinct().groupBy("edge_id").agg(F.count("*").alias("n"))
    good = edges.join(met, "edge_id").where(F.col("n") == F.size("src"))
    return _share(edges, good, max_size)


def weak_reciprocity(edges: DataFrame, max_size: int) -> DataFrame:
    """Per size, the share of edges of which some target leads to some source in some edge."""
    edges = edges.where(F.col("size") <= max_size)
    need = edges.select("edge_id", F.explode("src").alias("t"), "tgt").select("edge_id", "t", F.explode("tgt").alias("s"))
    return _share(edges, need.join(_arcs(edges), ["s", "t"], "left_semi"), max_size)
