"""Statistically validated edges and cores."""

from __future__ import annotations

from math import comb, lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from polyad.operators.projections import subsets_of_size
from polyad.runtime import cut


def binomial_tail(n: int, p: float, at_least: int) -> float:
    """P[Binomial(n, p) >= at_least]."""
    return float(binomial_tails(np.array([n]), np.array([p]), np.array([at_least]))[0])


def binomial_tails(n: np.ndarray, p: np.ndarray, at_least: np.ndarray) -> np.ndarray:
    """P[Binomial(n, p) >= at_least] of many tests at once, summed in logarithms from the term at ``at_least`` on.

    Where ``at_least`` is no more than the mean, the terms below are summed instead: they are the shorter
    part, and no small number is lost in 1 - x.
    """
    n, p, k = np.asarray(n, np.int64), np.asarray(p, float), np.asarray(at_least, np.int64)
    out = np.where((k <= 0) | (p >= 1), 1.0, 0.0)
    open_ = (k > 0) & (k <= n) & (p > 0) & (p < 1)
    low = open_ & (k <= n * p)
    high = open_ & ~low
    out[high] = np.minimum(1.0, _sums(n[high], p[high], k[high], n[high]))
    out[low] = np.maximum(0.0, 1.0 - _sums(n[low], p[low], np.zeros(low.sum(), np.int64), k[low] - 1))
    return out


def _sums(n: np.ndarray, p: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of the binomial terms first..last, each ended where falling terms no longer change it; 64 terms of every open sum at a time."""
    logs_of = np.array([lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1) for a, b in zip(n.tolist(), first.tolist())]) if len(n) else np.zeros(0)
    odds = np.log(p) - np.log1p(-p)
    log_term = logs_of + first * np.log(p) + (n - first) * np.log1p(-p)
    total, at, todo = np.zeros(len(n)), first.astype(np.int64).copy(), np.arange(len(n))
    while len(todo):
        k = at[todo, None] + np.arange(64)
        inside = k <= last[todo, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = np.log(np.maximum(n[todo, None] - k, 0.0)) - np.log(k + 1.0) + odds[todo, None]
        logs = log_term[todo, None] + np.concatenate([np.zeros((len(todo), 1)), np.cumsum(steps[:, :-1], axis=1)], axis=1)
        terms = np.where(inside, np.exp(np.where(inside, logs, -np.inf)), 0.0)
        total[todo] += terms.sum(1)
        done = (k[:, -1] >= last[todo]) | ((terms[:, -1] <= total[todo] * 1e-18) & (k[:, -1] > n[todo] * p[todo]))
        log_term[todo], at[todo] = logs[:, -1] + steps[:, -1], k[:, -1] + 1
        todo = todo[~done]
    return total


@F.pandas_udf(DoubleType())
def tail(n: pd.Series, p: pd.Series, at_least: pd.Series) -> pd.Series:
    """``binomial_tails`` of a batch, each different test once."""
    tests = pd.DataFrame({"n": n, "p": p, "k": at_least})
    different, where = np.unique(tests.to_numpy(dtype=float), axis=0, return_inverse=True)
    return pd.Series(binomial_tails(different[:, 0].astype(np.int64), different[:, 1], different[:, 2].astype(np.int64))[where.ravel()])


def _stepped_up(tests: DataFrame, alpha: float) -> DataFrame:
    """``fdr``, the largest r * alpha / n_tests that the r-th least p-value is below, and ``validated`` (p < fdr); per ``size``.

    ``tests`` has ``size``, ``p_value`` and ``n_possible``. Values are counted per distinct p-value, which are
    ranked range by range: a range's ranks begin after the ranges of the size before it.
    """
    bonf = F.lit(alpha) / F.col("n_possible")
    counts = tests.groupBy("size", "p_value", "n_possible").agg(F.count("*").alias("n"))
    placed = cut(counts.repartitionByRange("size", "p_value").withColumn("part", F.spark_partition_id()))  # the ranges must be the same in both reads
    of_parts = placed.groupBy("size", "part").agg(F.sum("n").alias("n"))  # a row per range and size
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_parts.select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # the last of equal p-values has the highest rank
    own = F.sum("n").over(Window.partitionBy("size", "part").orderBy("p_value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.join(starts, ["size", "part"]).withColumn("line", (F.col("start") + own) * bonf)
    passed = ranked.groupBy("size").agg(F.max(F.when(F.col("p_value") < F.col("line"), F.col("line"))).alias("fdr"))
    joined = tests.join(passed, "size").withColumn("fdr", F.coalesce("fdr", F.lit(0.0)))
    return joined.withColumn("validated", F.col("p_value") < F.col("fdr"))


def edge_tests(edges: DataFrame, *, max_size: int = 10) -> DataFrame:
    """``size``, ``nodes``, ``n_observed``, ``n_edges``, ``expected_p`` and ``n_possible`` for every edge of 2..max_size nodes.

    Within a size, with weights as multiplicities: n_edges edges, of which node i is in K_i; chance gives
    an edge the probability prod K_i / n_edges.
    """
    used = edges.where(F.col("size").between(2, max_size)).select("edge_id", "nodes", F.size("nodes").alias("size"), F.col("weight").cast("bigint").alias("w"))
    total = used.groupBy("size").agg(F.sum("w").alias("n_edges"))
    held = used.select("edge_id", "size", "w", F.explode("nodes").alias("node"))
    of_node = held.groupBy("size", "node").agg(F.sum("w").alias("k"))
    n_nodes = of_node.groupBy("size").agg(F.count("*").alias("n_nodes"))
    logs = held.join(of_node, ["size", "node"]).join(total, "size").groupBy("edge_id").agg(F.sum(F.log(F.col("k") / F.col("n_edges"))).alias("log_p"))
    tests = used.join(logs, "edge_id").join(total, "size").join(n_nodes, "size")
    ways = F.exp(F.aggregate(F.sequence(F.lit(1), F.col("size")), F.lit(0.0), lambda s, k: s + F.log((F.col("n_nodes") - k + 1) / k)))
    return tests.select("size", "nodes", F.col("w").alias("n_observed"), "n_edges", F.exp("log_p").alias("expected_p"), ways.alias("n_possible"))


def validated_edges(edges: DataFrame, *, max_size: int = 10, alpha: float = 0.01) -> DataFrame:
    """``size``, ``nodes``, ``n_observed``, ``p_value``, ``fdr``, ``validated`` for every edge of 2..max_size nodes.

    p is the tail of the binomial; validated are p below the step-up line of alpha over the number of
    possible edges among the nodes that have edges of the size.
    """
    tests = edge_tests(edges, max_size=max_size).withColumn("p_value", tail("n_edges", "expected_p", "n_observed"))
    return _stepped_up(cut(tests), alpha).select("size", "nodes", "n_observed", "p_value", "fdr", "validated")


def validated_cores(edges: DataFrame, *, min_size: int = 2, max_size: int | None = None, alpha: float = 0.01) -> DataFrame:
    """``size``, ``nodes``, ``n_observed``, ``p_value``, ``fdr`` of the validated groups of nodes, largest first.

    For each size downward: the groups are all subsets of that size of the edges, without those inside
    a larger validated group; observed is the number of edges that hold the group, chance is by the
    nodes' shares of all edges. Weights are multiplicities.
    """
    held = cut(edges.select("edge_id", "nodes", F.col("weight").cast("bigint").alias("w")))
    largest = held.agg(F.max(F.size("nodes"))).first()[0] or 0
    top = min(max_size or largest, largest)
    n_edges = held.agg(F.sum("w")).first()[0] or 0
    of_node = cut(held.select("w", F.explode("nodes").alias("node")).groupBy("node").agg((F.sum("w") / n_edges).alias("share"))) if n_edges else None
    n_nodes = of_node.count() if n_edges else 0
    found = None
    for k in range(top, min_size - 1, -1):
        groups = subsets_of_size(held, k).join(held.select("edge_id", "w"), "edge_id").groupBy(F.col("part").alias("nodes")).agg(F.sum("w").alias("n_observed"))
        if found is not None:
            inner = subsets_of_size(found.select(F.lit(0).alias("edge_id"), "nodes").where(F.size("nodes") > k), k).select(F.col("part").alias("nodes")).distinct()
            groups = groups.join(inner, "nodes", "left_anti")
        logs = groups.select("nodes", F.explode("nodes").alias("node")).join(of_node, "node").groupBy("nodes").agg(F.exp(F.sum(F.log("share"))).alias("p"))
        tests = groups.join(logs, "nodes").withColumn("p_value", tail(F.lit(n_edges), "p", "n_observed"))
        tests = cut(tests.select(F.lit(k).alias("size"), "nodes", "n_observed", "p_value", F.lit(float(comb(n_nodes, k))).alias("n_possible")))
        good = cut(_stepped_up(tests, alpha).where("validated").select("size", "nodes", "n_observed", "p_value", "fdr"))
        found = good if found is None else cut(found.unionByName(good))
    if found is None:
        kind = edges.schema["nodes"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"size int, nodes {kind}, n_observed bigint, p_value double, fdr double")
    return found
