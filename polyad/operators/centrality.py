"""Eigenvector centralities of uniform hypergraphs and subhypergraph centrality."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.operators.edges import node_table
from polyad.operators.matrices import adjacency
from polyad.runtime import Rounds, bounded_rows, cut

#: Nodes up to which a dense matrix is solved on the driver.
DENSE = 3_000
#: What stands for a value that has become 0 in products made of logarithms.
TINY = 1e-300
#: Incidences up to which the rounds of an iteration run on arrays on the driver; more are joined in tables, round by round.
HELD_INCIDENCES = 6_000_000


def held_incidences(edges: DataFrame, limit: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray] | None:
    """Nodes in order, and per incidence the number of its edge and of its node, and per edge its weight; None beyond ``limit`` incidences."""
    if (edges.agg(F.sum(F.size("nodes"))).first()[0] or 0) > limit:
        return None
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    rows = edges.select("edge_id", "nodes", weight.cast("double").alias("weight")).toArrow()
    order = np.argsort(np.asarray(rows.column("edge_id")), kind="stable")
    lists = rows.column("nodes").take(order)
    sizes = np.asarray(lists.combine_chunks().value_lengths()) if len(order) else np.zeros(0, np.int64)
    names, at = np.unique(np.asarray(lists.combine_chunks().flatten()), return_inverse=True) if len(order) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return names.tolist(), np.repeat(np.arange(len(order)), sizes), at, np.asarray(rows.column("weight"))[order]


def _check_uniform(edges: DataFrame) -> int:
    low, high = edges.agg(F.min("size"), F.max("size")).first()
    if low is None or low != high or low < 2:
        raise InvalidParameterError("the measure is for hypergraphs whose edges all have one size of at least 2")
    return low


def _start(edges: DataFrame, seed: int | None) -> DataFrame:
    """Positive start values: equal ones, or by a hash of seed and node."""
    nodes = node_table(edges)
    if seed is None:
        return nodes.select("node", F.lit(1.0).alias("x"))
    return nodes.select("node", (F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 40)) / F.lit(float(1 << 40)) + 0.5).alias("x"))


def _scaled(x: DataFrame, norm: str) -> DataFrame:
    size = F.sqrt(F.sum(F.col("x") * F.col("x"))) if norm == "l2" else F.sum(F.abs("x"))
    return x.crossJoin(x.agg(size.alias("whole"))).select("node", (F.col("x") / F.col("whole")).alias("x"))  # whole is one row


def _until_stable(first: DataFrame, step, norm: str, tol: float, max_iter: int) -> DataFrame:
    rounds = Rounds()
    x = rounds.cut(_scaled(first, norm))
    for _ in range(max_iter):
        new = rounds.cut(_scaled(step(x), norm))
        gap = new.join(x.withColumnRenamed("x", "old"), "node").agg(F.sqrt(F.sum((F.col("x") - F.col("old")) ** 2))).first()[0] or 0.0
        x = new
        if gap < tol:
            break
    return x


def _until_stable_held(edges: DataFrame, held: tuple, first: DataFrame, step: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], norm: str, tol: float, max_iter: int) -> DataFrame:
    """The same rounds on arrays."""
    names, edge, node, _ = held
    table = first.toArrow()  # as many as the bounded incidences have nodes
    start = np.asarray(table.column("x"))[np.argsort(np.asarray(table.column("node")), kind="stable")]  # in the order of the names
    scale = (lambda x: x / np.sqrt((x * x).sum())) if norm == "l2" else (lambda x: x / np.abs(x).sum())
    x = scale(start)
    for _ in range(max_iter):
        new = scale(step(x, edge, node))
        gap, x = np.sqrt(((new - x) ** 2).sum()), new
        if gap < tol:
            break
    kind = edges.schema["nodes"].dataType.elementType.simpleString()
    found = edges.sparkSession.createDataFrame(pa.table({"node": names, "centrality": x}))
    return found.select(F.col("node").cast(kind).alias("node"), "centrality")


def clique_centrality(edges: DataFrame, *, tol: float = 1e-7, max_iter: int = 1000, seed: int | None = None) -> DataFrame:
    """``node``, ``centrality``: dominant eigenvector, of length 1, of the numbers of common edges of two nodes."""
    _check_uniform(edges)
    if held := held_incidences(edges, HELD_INCIDENCES):

        def on_arrays(x: np.ndarray, edge: np.ndarray, node: np.ndarray) -> np.ndarray:
            return np.bincount(node, np.bincount(edge, x[node])[edge] - x[node], len(x))

        return _until_stable_held(edges, held, _start(edges, seed), on_arrays, "l2", tol, max_iter)
    links = cut(adjacency(edges))

    def step(x: DataFrame) -> DataFrame:
        return links.join(x, F.col("col") == F.col("node")).groupBy(F.col("row").alias("node")).agg(F.sum(F.col("val") * F.col("x")).alias("x"))

    return _until_stable(_start(edges, seed), step, "l2", tol, max_iter).withColumnRenamed("x", "centrality")


def _tensor_step(held: DataFrame, power: float):
    """x_i <- (sum over edges of i of the product of the others' values) ** power; products are sums of logs, and a value that has become 0 counts as TINY."""

    def step(x: DataFrame) -> DataFrame:
        logs = held.join(x, "node").select("edge_id", "node", F.log(F.greatest("x", F.lit(TINY))).alias("l"))
        whole = logs.groupBy("edge_id").agg(F.sum("l").alias("total"))
        sums = logs.join(whole, "edge_id").groupBy("node").agg(F.sum(F.exp(F.col("total") - F.col("l"))).alias("x"))
        return sums.select("node", F.pow("x", F.lit(power)).alias("x"))

    return step


def _tensor_on_arrays(node: np.ndarray, size: int, power: float):
    """The same on arrays, by products of the values before and after each: edges of one size are the rows of a table."""
    columns = [np.ascontiguousarray(c) for c in node.reshape(-1, size).T]

    def step(x: np.ndarray, edge: np.ndarray, node: np.ndarray) -> np.ndarray:
        raised = np.maximum(x, TINY)
        values = [raised[c] for c in columns]
        before = [np.ones(len(values[0]))]
        for v in values[:-1]:
            before.append(before[-1] * v)
        after, out = np.ones(len(values[0])), np.zeros(len(x))
        for column, v, b in zip(reversed(columns), reversed(values), reversed(before)):
            out += np.bincount(column, b * after, len(x))
            after = after * v
        return out if power == 1 else out**power

    return step


def z_centrality(edges: DataFrame, *, tol: float = 1e-7, max_iter: int = 1000, seed: int | None = None) -> DataFrame:
    """``node``, ``centrality``: Z-eigenvector of the adjacency tensor, summing to 1."""
    size = _check_uniform(edges)
    if held := held_incidences(edges, HELD_INCIDENCES):
        return _until_stable_held(edges, held, _start(edges, seed), _tensor_on_arrays(held[2], size, 1.0), "l1", tol, max_iter)
    held = cut(edges.select("edge_id", F.explode("nodes").alias("node")))
    return _until_stable(_start(edges, seed), _tensor_step(held, 1.0), "l1", tol, max_iter).withColumnRenamed("x", "centrality")


def h_centrality(edges: DataFrame, *, tol: float = 1e-6, max_iter: int = 100, seed: int | None = None) -> DataFrame:
    """``node``, ``centrality``: H-eigenvector of the adjacency tensor, summing to 1."""
    size = _check_uniform(edges)
    if held := held_incidences(edges, HELD_INCIDENCES):
        return _until_stable_held(edges, held, _start(edges, seed), _tensor_on_arrays(held[2], size, 1.0 / (size - 1)), "l1", tol, max_iter)
    held = cut(edges.select("edge_id", F.explode("nodes").alias("node")))
    return _until_stable(_start(edges, seed), _tensor_step(held, 1.0 / (size - 1)), "l1", tol, max_iter).withColumnRenamed("x", "centrality")


def dense(matrix: DataFrame, nodes: DataFrame, limit: int = DENSE) -> tuple[list, np.ndarray]:
    """Nodes in order and the dense matrix of a (row, col, val) table, for at most ``limit`` nodes."""
    names = sorted(r.node for r in bounded_rows(nodes.select("node"), limit, "nodes of a dense matrix"))
    at = {x: k for k, x in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in bounded_rows(matrix, limit * limit, "entries of a dense matrix"):
        out[at[r.row], at[r.col]] = r.val
    return names, out


def subhypergraph_centrality(edges: DataFrame, *, limit: int = DENSE) -> DataFrame:
    """``node``, ``centrality``: log of the diagonal of the exponential of the adjacency matrix, by a dense eigensolver on the driver."""
    names, a = dense(adjacency(edges), node_table(edges), limit)
    values, vectors = np.linalg.eigh(a)
    top = values.max() if len(values) else 0.0
    score = top + np.log((vectors**2) @ np.exp(values - top)) if len(values) else np.zeros(0)
    kind = dict(edges.select(F.explode("nodes").alias("node")).dtypes)["node"]
    return edges.sparkSession.createDataFrame([(n, float(s)) for n, s in zip(names, score)], f"node {kind}, centrality double")
