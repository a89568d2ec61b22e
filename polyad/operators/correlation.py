"""Correlations in time: of adjacency at a lag, and of the distance of events with their delay."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.operators.centrality import HELD_INCIDENCES
from polyad.operators.matrices import temporal_adjacency
from polyad.runtime import cut


def _indexed(edges: DataFrame, n_times: int | None) -> tuple[DataFrame, int]:
    """Adjacency entries of orders 1.. with times as given; the number of times is the last one + 1 unless given."""
    if n_times is None:
        n_times = (edges.agg(F.max("time")).first()[0] or 0) + 1
    return edges, n_times


def correlation_function(edges: DataFrame, order_a: int, order_b: int, tau: int, *, n_times: int | None = None) -> float:
    """C_tau of two orders: the trace of sum_t (A_t - mean A)(B_{t+tau} - mean B)' / (a! b! (T - tau)).

    Times are 0..T-1, those without edges included. The centered matrices are never formed: the sum is
    expanded, so that only entries that aren't 0 are joined.
    """
    edges, t = _indexed(edges, n_times)
    if not 0 <= tau < t:
        raise InvalidParameterError("tau must lie between 0 and the number of times - 1")
    a = cut(temporal_adjacency(edges, order=order_a))
    b = cut(temporal_adjacency(edges, order=order_b)) if order_b != order_a else a
    met = a.select((F.col("time") + tau).alias("time"), "row", "col", F.col("val").alias("x")).join(b.select("time", "row", "col", F.col("val").alias("y")), ["time", "row", "col"])
    product = met.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0
    # sums over the first T - tau times of A and the last T - tau of B, and over all times
    sum_a = a.groupBy("row", "col").agg(F.sum(F.when(F.col("time") < t - tau, F.col("val")).otherwise(0)).alias("sa"), F.sum("val").alias("ma"))
    sum_b = b.groupBy("row", "col").agg(F.sum(F.when(F.col("time") >= tau, F.col("val")).otherwise(0)).alias("sb"), F.sum("val").alias("mb"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    both = sum_a.join(sum_b, ["row", "col"], "full").select(*[zero(c).alias(c) for c in ("sa", "ma", "sb", "mb")])
    mean_a, mean_b = F.col("ma") / t, F.col("mb") / t
    rest = both.agg(F.sum(-F.col("sa") * mean_b - mean_a * F.col("sb") + (t - tau) * mean_a * mean_b)).first()[0] or 0.0
    return (product + rest) / (math.factorial(order_a) * math.factorial(order_b) * (t - tau))


def cross_correlation(edges: DataFrame, order_a: int, order_b: int, tau: int, *, normalized: bool = True, n_times: int | None = None) -> float:
    """C_tau of two orders, divided by 2 sqrt(sigma_a sigma_b) if ``normalized``; sigma is the order's own C_0. 0 where a sigma is 0."""
    value = correlation_function(edges, order_a, order_b, tau, n_times=n_times)
    if not normalized:
        return value
    scale = correlation_function(edges, order_a, order_a, 0, n_times=n_times) * correlation_function(edges, order_b, order_b, 0, n_times=n_times)
    return value / (2 * math.sqrt(scale)) if scale > 0 else 0.0


def gap_function(edges: DataFrame, order_a: int, order_b: int, tau: int, *, n_times: int | None = None) -> float:
    """(C_tau of a, b - C_tau of b, a) / 2 sqrt(sigma_a sigma_b): which order leads; antisymmetric."""
    return cross_correlation(edges, order_a, order_b, tau, n_times=n_times) - cross_correlation(edges, order_b, order_a, tau, n_times=n_times)


def correlation_table(edges: DataFrame, max_order: int, taus: list[int], *, n_times: int | None = None) -> DataFrame:
    """``order_a``, ``order_b``, ``tau``, ``correlation`` for all pairs of orders, each computed in its own direction."""
    edges, t = _indexed(edges, n_times)
    if not all(0 <= tau < t for tau in taus):
        raise InvalidParameterError("tau must lie between 0 and the number of times - 1")
    used = edges.where(F.col("size").between(2, max_order + 1))
    held, spark = _held_times(used), edges.sparkSession
    if held is not None:
        known = cut(_overlap_values(spark, held, taus, t).where("correlation != 0"))
    else:
        rows = [(a, b, tau, _scaled(v, a, b, t - tau)) for (a, b, tau), v in _entry_sums(used, taus, t).items()]
        known = spark.createDataFrame(rows, "order_a int, order_b int, tau int, correlation double")
    orders = spark.range(1, max_order + 1).select(F.col("id").cast("int").alias("order_a"))
    every = orders.crossJoin(orders.withColumnRenamed("order_a", "order_b")).crossJoin(spark.createDataFrame([(tau,) for tau in taus], "tau int"))  # as many rows as the result has
    return every.join(known, ["order_a", "order_b", "tau"], "left").select("order_a", "order_b", "tau", F.coalesce("correlation", F.lit(0.0)).alias("correlation"))


def _scaled(value: Fraction | float, a: int, b: int, times: int) -> float:
    """value / (a! b! times), as a fraction, for factorials of large orders are beyond a float; 0 where it is far below the least one."""
    value = Fraction(value)
    if not value:
        return 0.0
    log = math.log(abs(value.numerator)) - math.log(value.denominator) - math.lgamma(a + 1) - math.lgamma(b + 1) - math.log(times)
    if log < -800:
        return math.copysign(0.0, value)
    return float(value / (math.factorial(a) * math.factorial(b) * times))


def _held_times(used: DataFrame) -> tuple | None:
    """The incidences of ``used`` and every edge's time and order; None beyond ``HELD_INCIDENCES``."""
    if (used.agg(F.sum(F.size("nodes"))).first()[0] or 0) > HELD_INCIDENCES:
        return None
    rows = used.select("time", (F.col("size") - 1).cast("bigint").alias("order"), "nodes").toArrow()
    lists = rows.column("nodes").combine_chunks()
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32), 0
    names, node = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    return rows.column("time").to_numpy(), rows.column("order").to_numpy(), starts, node.astype(np.int32), len(names)


def _overlap_values(spark: SparkSession, held: tuple, taus: list[int], t: int) -> DataFrame:
    """The correlations of the orders that edges have, from exact sums over the numbers of common nodes of the edges.

    Two edges with m nodes in common have m (m - 1) entries in common, so no entry is made: a task counts the
    common nodes of its edges with all edges by the lists of the nodes' edges.
    """
    time, order, starts, node, n_nodes = held
    n, schema = len(time), "order_a int, order_b int, tau int, correlation double"
    if not n:
        return spark.createDataFrame([], schema)
    kinds, kind = np.unique(order, return_inverse=True)
    edge = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))[np.argsort(node, kind="stable")]
    firsts = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=n_nodes))])
    shared = spark.sparkContext.broadcast((time, kind, starts, node, edge, firsts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time, kind, starts, node, edge, firsts = shared.value
        # per order and tau: entries of edges tau apart, with the first among the first times, with the second among the last, and all
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for e in batch.column(0).to_numpy():
                own = node[starts[e] : starts[e + 1]]
                counts = firsts[own + 1] - firsts[own]
                at = np.repeat(firsts[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                m = np.bincount(edge[at], minlength=len(time))
                others = np.flatnonzero(m > 1)
                both, to = m[others] * (m[others] - 1), kind[others]
                row = sums.setdefault(int(kind[e]), np.zeros((len(taus), 4, len(kinds)), dtype=np.int64))
                for j, tau in enumerate(taus):
                    for c, seen in enumerate((time[others] == time[e] + tau, np.full(len(others), time[e] < t - tau), time[others] >= tau, np.ones(len(others), bool))):
                        row[j, c] += np.bincount(to[seen], both[seen], len(kinds)).astype(np.int64)
        for k, row in sums.items():
            j, c, to = np.nonzero(row)
            yield pa.RecordBatch.from_pydict({"j": j, "c": c, "cell": k * len(kinds) + to, "v": row[j, c, to]})

    parts = spark.range(n, numPartitions=min(n, 64)).mapInArrow(run, "j bigint, c bigint, cell bigint, v bigint").groupBy("j", "cell").pivot("c", [0, 1, 2, 3]).sum("v")

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for j, cell, *sums in zip(*(c.to_pylist() for c in batch.columns)):
                (a, b), tau = divmod(cell, len(kinds)), taus[j]
                met, first, last, whole = (x or 0 for x in sums)
                value = met - Fraction(first + last, t) + Fraction((t - tau) * whole, t * t)
                rows.append((int(kinds[a]), int(kinds[b]), tau, _scaled(value, int(kinds[a]), int(kinds[b]), t - tau)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["order_a", "order_b", "tau", "correlation"])

    return parts.select("j", "cell", "0", "1", "2", "3").mapInArrow(scale, schema)


def _entry_sums(used: DataFrame, taus: list[int], t: int) -> dict[tuple[int, int, int], float]:
    """The same sums by joins of the entries, for any number of incidences."""
    pairs = used.select("time", (F.col("size") - 1).alias("order"), "nodes", F.explode("nodes").alias("row")).select("time", "order", "row", F.explode("nodes").alias("col")).where("row != col")
    entries = cut(pairs.groupBy("order", "time", "row", "col").agg(F.count("*").cast("double").alias("val")))
    orders = ["order_a", "order_b"]
    value: dict[tuple[int, int, int], float] = {}
    for tau in taus:
        a = entries.select(F.col("order").alias("order_a"), (F.col("time") + tau).alias("time"), "row", "col", F.col("val").alias("x"))
        met = a.join(entries.withColumnsRenamed({"order": "order_b", "val": "y"}), ["time", "row", "col"]).groupBy(*orders).agg(F.sum(F.col("x") * F.col("y")).alias("v"))
        # every term of the rest has a factor of each order, so only entries that both have count
        sums = entries.groupBy("order", "row", "col").agg(F.sum(F.when(F.col("time") < t - tau, F.col("val")).otherwise(0)).alias("first"), F.sum(F.when(F.col("time") >= tau, F.col("val")).otherwise(0)).alias("last"), (F.sum("val") / t).alias("mean"))
        sums = cut(sums)
        both = sums.select(F.col("order").alias("order_a"), "row", "col", F.col("first").alias("sa"), F.col("mean").alias("ma")).join(sums.select(F.col("order").alias("order_b"), "row", "col", F.col("last").alias("sb"), F.col("mean").alias("mb")), ["row", "col"])
        rest = both.groupBy(*orders).agg(F.sum(-F.col("sa") * F.col("mb") - F.col("ma") * F.col("sb") + (t - tau) * F.col("ma") * F.col("mb")).alias("v"))
        for r in met.unionByName(rest).groupBy(*orders).agg(F.sum("v").alias("v")).collect():  # a row per pair of orders
            value[r.order_a, r.order_b, tau] = r.v
    return value


def correlation_matrix(edges: DataFrame, order_a: int, order_b: int, tau: int, *, n_times: int | None = None) -> DataFrame:
    """``row``, ``col``, ``val`` of sum_t (A_t - mean A)(B_{t+tau} - mean B)' / (a! b! (T - tau)), entries of nodes with edges of both orders."""
    edges, t = _indexed(edges, n_times)
    a = cut(temporal_adjacency(edges, order=order_a))
    b = cut(temporal_adjacency(edges, order=order_b))
    scale = math.factorial(order_a) * math.factorial(order_b) * (t - tau)
    met = a.select((F.col("time") + tau).alias("time"), "row", F.col("col").alias("k"), F.col("val").alias("x")).join(b.select("time", F.col("row").alias("to"), F.col("col").alias("k"), F.col("val").alias("y")), ["time", "k"])
    first = met.groupBy("row", F.col("to").alias("col")).agg(F.sum(F.col("x") * F.col("y")).cast("double").alias("val"))
    sa = a.groupBy("row", F.col("col").alias("k")).agg(F.sum(F.when(F.col("time") < t - tau, F.col("val")).otherwise(0)).alias("s"), (F.sum("val") / t).alias("m"))
    sb = b.groupBy(F.col("row").alias("to"), F.col("col").alias("k")).agg(F.sum(F.when(F.col("time") >= tau, F.col("val")).otherwise(0)).alias("s2"), (F.sum("val") / t).alias("m2"))
    second = sa.join(sb, "k").groupBy("row", F.col("to").alias("col")).agg(F.sum(-F.col("s") * F.col("m2") - F.col("m") * F.col("s2") + (t - tau) * F.col("m") * F.col("m2")).alias("val"))
    return first.unionByName(second).groupBy("row", "col").agg((F.sum("val") / scale).alias("val"))


def edge_distances(edges: DataFrame, *, max_hops: int | None = None) -> DataFrame:
    """``edge_a``, ``edge_b``, ``distance``: least hops between their nodes + 1, for different edges that are connected.

    Every edge's front alternates between nodes and edges, so links between nodes and pairs of members are never stored.
    """
    held = cut(edges.select("edge_id", F.explode("nodes").alias("node")))
    fresh = reached = held.select(F.col("edge_id").alias("edge_a"), "node")
    found, distance = None, 0
    while max_hops is None or distance <= max_hops:
        distance += 1
        met = fresh.join(held.withColumnRenamed("edge_id", "edge_b"), "node").where("edge_a != edge_b").select("edge_a", "edge_b").distinct()
        met = met if found is None else met.join(found, ["edge_a", "edge_b"], "left_anti")
        step = cut(met.withColumn("distance", F.lit(distance)))
        found = step if found is None else found.unionByName(step)
        if step.isEmpty():
            break
        ahead = step.join(held.withColumnRenamed("edge_id", "edge_b"), "edge_b").select("edge_a", "node").distinct()
        fresh = cut(ahead.join(reached, ["edge_a", "node"], "left_anti"))
        reached = reached.unionByName(fresh)
    return found


def pair_distances(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``edge_a``, ``edge_b``, ``distance`` as in ``edge_distances``, for the given pairs of edges alone.

    Both ends spread by turns from nodes to their edges and on to the edges' nodes, until they meet halfway. Only
    ends of pairs that haven't met spread; a pair whose end has reached its whole component never will.
    """
    held = cut(edges.select("edge_id", F.explode("nodes").alias("node")))
    waiting = cut(pairs.select("edge_a", "edge_b").where("edge_a != edge_b").distinct())
    ends = lambda: waiting.select(F.explode(F.array("edge_a", "edge_b")).alias("end")).distinct()
    ball = cut(held.join(ends().withColumnRenamed("end", "edge_id"), "edge_id").select(F.col("edge_id").alias("end"), F.col("node").alias("x")))
    found, distance, sizes = None, 0, [ball.groupBy("end").agg(F.count("*").alias("n"))]
    while True:
        distance += 1
        a, b = (ball.select(F.col("end").alias(f"edge_{x}"), "x") for x in "ab")
        met = cut(waiting.join(a, "edge_a").join(b, ["edge_b", "x"]).select("edge_a", "edge_b").distinct().withColumn("distance", F.lit(distance)))
        found = met if found is None else found.unionByName(met)
        waiting = waiting.join(met, ["edge_a", "edge_b"], "left_anti")
        if distance > 2:
            still = sizes[-1].join(sizes[-3], ["end", "n"]).select("end")
            for x in "ab":
                waiting = waiting.join(still.withColumnRenamed("end", f"edge_{x}"), f"edge_{x}", "left_anti")
        waiting = cut(waiting.select("edge_a", "edge_b"))
        if waiting.isEmpty():
            return found
        ball = ball.join(ends(), "end", "left_semi")
        steps = held.select(F.col("node").alias("x"), F.col("edge_id").alias("to")) if distance % 2 else held.select(F.col("edge_id").alias("x"), F.col("node").alias("to"))
        ball = cut(ball.join(steps, "x").select("end", F.col("to").alias("x")).distinct())
        sizes.append(cut(ball.groupBy("end").agg(F.count("*").alias("n"))))


def _near_events(events: DataFrame, delays: list[int], size: int | None, other_size: int | None) -> DataFrame:
    """Pairs of events less than the largest delay apart; ``event_distances`` says which."""
    if not delays or min(delays) < 1:
        raise InvalidParameterError("delays must be at least 1")
    span = max(delays)
    own = events.withColumn("event", F.xxhash64("time", "edge_id"))
    first = own if size is None else own.where(F.col("size") == size)
    second = first if other_size is None else own.where(F.col("size") == other_size)
    a = first.select(F.col("event").alias("event_a"), F.col("edge_id").alias("edge_a"), F.col("time").alias("t"), F.col("size").alias("size_a"), F.explode(F.array(F.expr(f"time div {span}"), F.expr(f"time div {span} + 1"))).alias("block"))
    b = second.select(F.col("event").alias("event_b"), F.col("edge_id").alias("edge_b"), F.col("time").alias("u"), F.col("size").alias("size_b"), F.expr(f"time div {span}").alias("block"))
    near = a.join(b, "block").where(f"u >= t AND u - t < {span}")
    near = near.where("(u > t OR event_a < event_b)") if other_size is None else near
    return near.where("size_a = size_b") if size is None and other_size is None else near


def near_pairs(events: DataFrame, delays: list[int], *, size: int | None = None, other_size: int | None = None) -> DataFrame:
    """``edge_a``, ``edge_b``: the different edges whose distances ``event_distances`` looks up."""
    return _near_events(events, delays, size, other_size).select("edge_a", "edge_b").where("edge_a != edge_b").distinct()


def event_distances(events: DataFrame, distances: DataFrame, delays: list[int], *, size: int | None = None, other_size: int | None = None) -> DataFrame:
    """``delay``, ``distance``, ``n``: histogram of the distances of pairs of events less than ``delay`` apart, nested in the delays.

    ``events`` has ``time``, ``edge_id``, ``size``; pairs are (earlier or simultaneous, later), each once,
    of one size, or of ``size`` and ``other_size``. The interval join is on blocks of time as long as the
    largest delay, so an event meets only its own block and the next.
    """
    near = _near_events(events, delays, size, other_size)
    apart = near.join(distances, ["edge_a", "edge_b"], "left").withColumn("distance", F.when(F.col("edge_a") == F.col("edge_b"), F.lit(0)).otherwise(F.col("distance"))).where("distance IS NOT NULL")
    wanted = F.explode(F.filter(F.array(*[F.lit(d) for d in sorted(delays)]), lambda d: d > F.col("u") - F.col("t")))
    return apart.select(wanted.alias("delay"), "distance").groupBy("delay", "distance").agg(F.count("*").alias("n"))


def distance_by_delay(histogram: DataFrame) -> DataFrame:
    """``delay``, ``mean`` distance, and ``relative``: mean over the mean at the largest delay."""
    means = histogram.groupBy("delay").agg((F.sum(F.col("distance") * F.col("n")) / F.sum("n")).alias("mean"))
    last = means.agg(F.max_by("mean", "delay").alias("whole"))
    return means.crossJoin(last).select("delay", "mean", F.try_divide("mean", "whole").alias("relative"))  # last is one row


def delay_slope(curve: DataFrame) -> float | None:
    """Slope of the relative distance against the logarithm of the delay, from its least value on."""
    rows = sorted((r.delay, r.relative) for r in curve.collect() if r.relative is not None)  # a row per delay
    if not rows:
        return None
    start = min(range(len(rows)), key=lambda k: rows[k][1])
    xs, ys = [math.log(d) for d, _ in rows[start:]], [y for _, y in rows[start:]]
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    var = sum((x - mx) ** 2 for x in xs)
    return sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / var if var else None
