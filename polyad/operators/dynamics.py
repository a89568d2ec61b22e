"""Random walks, contagion and the stability of synchronous states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError, MissingNodeError
from polyad.operators.edges import node_table
from polyad.operators.matrices import transition_matrix
from polyad.operators.projections import node_pairs
from polyad.runtime import Rounds, cut


def walk_density(edges: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """``step`` 0..steps, ``node``, ``density``: how a density (``node``, ``density``) spreads by the random walk."""
    moves = cut(transition_matrix(edges))
    now = cut(start.select("node", F.col("density").cast("double").alias("density")))
    out = now.select(F.lit(0).alias("step"), "node", "density")
    for k in range(1, steps + 1):
        spread = now.join(moves, F.col("node") == F.col("row")).groupBy(F.col("col").alias("node")).agg(F.sum(F.col("density") * F.col("val")).alias("density"))
        now = cut(spread)
        out = out.unionByName(now.select(F.lit(k).alias("step"), "node", "density"))
    return out


def walk_stationary(edges: DataFrame) -> DataFrame:
    """``node`` and ``density`` of the stationary state of the random walk on a connected hypergraph.

    The unnormalized transition matrix is symmetric, so the state is each row's share of the whole: no iteration.
    """
    pairs = node_pairs(edges).select(F.explode(F.array("a", "b")).alias("node"), (F.col("size") - 1).alias("w"))
    rows = pairs.groupBy("node").agg(F.sum("w").cast("double").alias("w"))
    total = rows.agg(F.sum("w").alias("total"))
    return rows.crossJoin(total).select("node", (F.col("w") / F.col("total")).alias("density"))  # total is one row


def random_walk(edges: DataFrame, start, steps: int, *, seed: int = 0) -> list:
    """One walk of ``steps`` steps from ``start``: a list of steps + 1 nodes.

    Every step reads the edges of the present node and no matrix is made: a node is walked to in proportion to
    the sum of (size - 1) over the edges that it shares with the present one.
    """
    held = edges.where("size(nodes) > 1").select("nodes")
    rng, path = np.random.default_rng(seed), [start]
    for _ in range(steps):
        own = held.where(F.array_contains("nodes", path[-1])).toArrow().column("nodes")  # a node's own edges
        lists = [x.as_py() for x in own]
        weight: dict = {}
        for nodes in lists:
            for x in nodes:
                weight[x] = weight.get(x, 0) + len(nodes) - 1
        weight.pop(path[-1], None)
        if not weight:
            raise MissingNodeError(f"{path[-1]!r} has no neighbors to walk to")
        near = sorted(weight)
        p = np.array([weight[x] for x in near], dtype=float)
        path.append(near[int(rng.choice(len(near), p=p / p.sum()))])
    return path


def _uniform(seed: int, step: int, *columns: str):
    """A reproducible number in [0, 1) per row, the same wherever and however often it is computed."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(step), *columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def contagion(edges: DataFrame, infected: DataFrame, steps: int, *, beta: float, beta_d: float, mu: float, seed: int = 0, nodes: DataFrame | None = None) -> DataFrame:
    """``step`` 0..steps - 1 and ``share`` of infected nodes: synchronous contagion over pairs (``beta``) and triples (``beta_d``).

    A susceptible node escapes each infected neighbor of a pair with 1 - beta and each triple whose two
    others are infected with 1 - beta_d; infected nodes recover with ``mu``. After extinction the share
    stays 0. Draws are hashes of seed, step and node, so a run is reproducible on any cluster.
    """
    if not all(0 <= x <= 1 for x in (beta, beta_d, mu)):
        raise InvalidParameterError("probabilities lie between 0 and 1")
    every = cut(node_table(edges, nodes))
    held = cut(edges.where("size(nodes) IN (2, 3)").select("edge_id", F.size("nodes").alias("k"), F.explode("nodes").alias("node")))
    rounds = Rounds()
    now = rounds.cut(every.join(infected.select("node").distinct(), "node", "left_semi"))
    n, shares = every.count(), []
    for step in range(steps):
        count = now.count()
        shares.append((step, count / n if n else 0.0))
        if not count or step == steps - 1:
            shares += [(k, 0.0) for k in range(step + 1, steps)] if not count else []
            break
        state = held.join(now.withColumn("sick", F.lit(1)), "node", "left").withColumn("sick", F.coalesce("sick", F.lit(0)))
        of_edge = state.groupBy("edge_id").agg(F.sum("sick").alias("n_sick"))
        ready = state.where("sick = 0").join(of_edge, "edge_id").where("n_sick = k - 1")
        threat = ready.groupBy("node").agg(F.sum((F.col("k") == 2).cast("int")).alias("pairs"), F.sum((F.col("k") == 3).cast("int")).alias("triples"))
        safe = F.pow(F.lit(1 - beta), F.col("pairs")) * F.pow(F.lit(1 - beta_d), F.col("triples"))
        caught = threat.where(_uniform(seed, 2 * step, "node") < 1 - safe).select("node")
        stay = now.where(_uniform(seed, 2 * step + 1, "node") >= mu).select("node")
        now = rounds.cut(stay.unionByName(caught))
    return edges.sparkSession.createDataFrame(shares, "step int, share double")


# -- stability of synchronous states


def integrate(f: Callable[[float, np.ndarray], np.ndarray], x: np.ndarray, time: float, step: float) -> np.ndarray:
    """Classical Runge-Kutta of order 4."""
    t, n = 0.0, max(1, round(time / step))
    h = time / n
    for _ in range(n):
        a = f(t, x)
        b = f(t + h / 2, x + h / 2 * a)
        c = f(t + h / 2, x + h / 2 * b)
        d = f(t + h, x + h * c)
        x = x + h / 6 * (a + 2 * b + 2 * c + d)
        t += h
    return x


def lyapunov(alpha: float, system, jacobian, coupling, start, params: tuple, *, time: float, step: float, cycles: int, seed: int) -> float:
    """Largest exponent of the variation eta' = (JF(x) - alpha JH(x)) eta along the orbit, renormalized once per cycle."""
    rng = np.random.default_rng(seed)
    x = np.asarray(start, dtype=float)
    dim = len(x)
    eta = rng.standard_normal(dim)
    y = np.concatenate([x, eta / np.linalg.norm(eta)])

    def f(t, y):
        x, eta = y[:dim], y[dim:]
        return np.concatenate([system(t, x, *params), (jacobian(x, *params) - alpha * coupling(x, *params)) @ eta])

    total = 0.0
    for _ in range(cycles):
        y = integrate(f, y, time / cycles, step)
        size = np.linalg.norm(y[dim:])
        total += np.log(max(size, 1e-300))
        y[dim:] = y[dim:] / size if size > 0 else y[dim:]
    return total / time


def master_stability(spark, system, jacobian, coupling, alphas: list[float], start, params: tuple = (), *, transient: float = 100.0, time: float = 400.0, step: float = 0.01, cycles: int = 100, seed: int = 0) -> DataFrame:
    """``alpha`` and ``exponent``: the master stability function over values of the coupling, one task per value."""
    settled = integrate(lambda t, x: system(t, x, *params), np.asarray(start, dtype=float), transient, step) if transient > 0 else np.asarray(start, dtype=float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(exponent=[lyapunov(a, system, jacobian, coupling, settled, params, time=time, step=step, cycles=cycles, seed=seed) for a in frame["alpha"]])

    frame = spark.createDataFrame([(float(a),) for a in alphas], "alpha double").repartition(max(1, len(alphas)))
    return frame.mapInPandas(run, "alpha double, exponent double")


def is_natural_coupling(couplings: list, dim: int, *, params: tuple = (), samples: int = 20, seed: int = 0) -> bool:
    """Whether all coupling Jacobians agree on random states, so that one matrix stands for every order."""
    rng = np.random.default_rng(seed)
    states = rng.standard_normal((samples, dim))
    return all(np.allclose(couplings[0](x, *params), other(x, *params)) for x in states for other in couplings[1:])


def is_all_to_all(edges: DataFrame, nodes: DataFrame | None = None) -> bool:
    """Whether every order up to the largest has all its possible edges."""
    from math import comb

    n = node_table(edges, nodes).count()
    counts = {r.size: r["count"] for r in edges.groupBy("size").count().collect()}  # one row per size
    top = max(counts, default=0)
    return top >= 2 and all(counts.get(k, 0) == comb(n, k) for k in range(2, top + 1))


def higher_order_stability(edges: DataFrame, system, jacobian, couplings: list, sigmas: list[float], alphas: list[float], start, params: tuple = (), **options) -> DataFrame | None:
    """The master stability function of a hypergraph with one coupling per order, if it depends on one value.

    With natural coupling it is that of the common coupling, to be read at the eigenvalues of the
    multiorder Laplacian; on an all-to-all hypergraph the orders' couplings add up by the number of
    edges through two nodes; otherwise there is none.
    """
    from math import comb

    if is_natural_coupling(couplings, len(start), params=params):
        return master_stability(edges.sparkSession, system, jacobian, couplings[0], alphas, start, params, **options)
    if not is_all_to_all(edges):
        return None
    n = node_table(edges).count()

    def joint(x, *p):
        return sum(s / sigmas[0] * comb(n - 2, k) * h(x, *p) for k, (s, h) in enumerate(zip(sigmas, couplings)))

    return master_stability(edges.sparkSession, system, jacobian, joint, alphas, start, params, **options)
