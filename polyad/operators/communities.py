"""Community models: mixed-membership block model, per-size model, spectral clustering, core-periphery, edge clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.functions.columns import log_choose
from polyad.operators.centrality import DENSE, HELD_INCIDENCES, dense, held_incidences
from polyad.operators.edges import node_table
from polyad.operators.projections import line_graph
from polyad.runtime import Rounds, bounded_rows, cut

# -- mixed-membership stochastic block model


@dataclass
class MixedMembership:
    """``u`` (``node``, ``u`` ARRAY<DOUBLE>), the affinity ``w`` between communities and the log-likelihood."""

    u: DataFrame
    w: np.ndarray
    log_likelihood: float
    rounds: int


def log_kappa(size: int, n_nodes: int) -> float:
    """log C(N - 2, size - 2) + log(size (size - 1) / 2)."""
    return log_choose(n_nodes - 2, size - 2) + math.log(size * (size - 1) / 2)


def size_factor(max_size: int) -> float:
    """C = sum over sizes d of 2 / (d (d - 1))."""
    return sum(2 / (d * (d - 1)) for d in range(2, max_size + 1))


def _edge_sums(held: DataFrame, u: DataFrame, w: np.ndarray, k: int) -> DataFrame:
    """Per edge ``s`` = sum of u and ``lam`` = (s'ws - sum of u'wu) / 2."""
    parts = [F.sum(F.col("u")[a]).alias(f"s{a}") for a in range(k)]
    own = sum((F.lit(float(w[a, b])) * F.col("u")[a] * F.col("u")[b] for a in range(k) for b in range(k)), F.lit(0.0))
    sums = held.join(u, "node").withColumn("own", own).groupBy("edge_id", "weight").agg(*parts, F.sum("own").alias("own"))
    both = sum((F.lit(float(w[a, b])) * F.col(f"s{a}") * F.col(f"s{b}") for a in range(k) for b in range(k)), F.lit(0.0))
    return sums.select("edge_id", "weight", F.array(*[F.col(f"s{a}") for a in range(k)]).alias("s"), F.greatest((both - F.col("own")) / 2, F.lit(1e-300)).alias("lam"))


def _outer(df: DataFrame, column: str, factor: str, k: int) -> np.ndarray:
    cells = [F.sum(F.col(factor) * F.col(column)[a] * F.col(column)[b]).alias(f"c{a}_{b}") for a in range(k) for b in range(k)]
    row = df.agg(*cells).first()  # k x k numbers
    return np.array([row[c] or 0.0 for c in range(k * k)]).reshape(k, k)


def fit_mixed_membership(edges: DataFrame, k: int, *, n_iter: int = 100, tolerance: float | None = None, assortative: bool = False, u_prior: float = 0.0, w_prior: float = 1.0, seed: int = 0, check_every: int = 10) -> MixedMembership:
    """Mixed memberships by expectation-maximization: lambda_e = (s'ws - sum u'wu) / 2 with s the sum of u over the edge.

    Memberships stay a table; only K x K matrices and K vectors reach the driver. Every round joins the
    incidences with the memberships once for each of the updates of w and of u.
    """
    if k < 1:
        raise InvalidParameterError("k must be at least 1")
    used = edges.where("size >= 2")
    held = cut(used.select("edge_id", "weight", F.explode("nodes").alias("node")))
    max_size = used.agg(F.max("size")).first()[0] or 2
    rng = np.random.default_rng(seed)
    w = np.diag(rng.random(k)) if assortative else rng.random((k, k))
    w = (w + w.T) / 2
    draw = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.pmod(F.xxhash64(F.lit(seed), F.col("node"), c), F.lit(1 << 40)) / F.lit(float(1 << 40)) + 1e-3)
    u = cut(node_table(edges).select("node", draw.alias("u")))
    if arrays := held_incidences(used, HELD_INCIDENCES):
        return _mixed_on_arrays(edges, arrays, u, w, k, max_size, n_iter, tolerance, assortative, u_prior, w_prior, check_every)
    rounds, tables, edge_tables = 0, Rounds(), Rounds()
    for rounds in range(1, n_iter + 1):
        sums = edge_tables.cut(_edge_sums(held, u, w, k).withColumn("m", F.col("weight") / F.col("lam")))
        bm = held.join(sums.select("edge_id", "m"), "edge_id").groupBy("node").agg(F.sum("m").alias("bm"))
        top = _outer(sums, "s", "m", k) - _outer(u.join(bm, "node"), "u", "bm", k)
        total = np.array([x or 0.0 for x in u.agg(*[F.sum(F.col("u")[a]) for a in range(k)]).first()])
        below = np.outer(total, total) - _outer(u.withColumn("one", F.lit(1.0)), "u", "one", k)
        new_w = 0.5 * w * top / (0.5 * below + w_prior)
        new_w = np.diag(np.diag(new_w)) if assortative else (new_w + new_w.T) / 2
        sums = edge_tables.cut(_edge_sums(held, u, new_w, k).withColumn("m", F.col("weight") / F.col("lam")))
        # (B m) S w - (B m) u w over (w sum u - u w + prior), in the node's own row
        near = held.join(sums.select("edge_id", "m", "s"), "edge_id").groupBy("node").agg(F.sum("m").alias("bm"), F.array(*[F.sum(F.col("m") * F.col("s")[a]) for a in range(k)]).alias("ms"))
        base = new_w @ total
        joined = u.join(near, "node", "left")
        up = [sum((F.lit(float(new_w[b, a])) * (F.coalesce(F.col("ms")[b], F.lit(0.0)) - F.coalesce("bm", F.lit(0.0)) * F.col("u")[b]) for b in range(k)), F.lit(0.0)) for a in range(k)]
        down = [F.lit(float(base[a])) - sum((F.lit(float(new_w[b, a])) * F.col("u")[b] for b in range(k)), F.lit(0.0)) + u_prior for a in range(k)]
        new_u = tables.cut(joined.select("node", F.array(*[F.when(down[a] > 0, F.col("u")[a] * F.greatest(up[a], F.lit(0.0)) / down[a]).otherwise(F.lit(0.0)) for a in range(k)]).alias("u")))
        done = False
        if tolerance is not None and rounds % check_every == 0:
            gap = new_u.select("node", F.col("u").alias("new")).join(u, "node").agg(F.sum(sum(((F.col("new")[a] - F.col("u")[a]) ** 2 for a in range(k)), F.lit(0.0))), F.count("*")).first()
            done = math.sqrt(gap[0] or 0.0) / max(1, gap[1]) < tolerance and np.linalg.norm(new_w - w) / k < tolerance
        u, w = new_u, new_w
        if done:
            break
    likelihood = mixed_log_likelihood(held, u, w, k)
    return MixedMembership(u, w / size_factor(max_size), likelihood, rounds)


def _mixed_on_arrays(edges: DataFrame, arrays: tuple, first: DataFrame, w: np.ndarray, k: int, max_size: int, n_iter: int, tolerance: float | None, assortative: bool, u_prior: float, w_prior: float, check_every: int) -> MixedMembership:
    """The same rounds on arrays, for incidences that have been counted. Nodes without edges of two nodes stay at what chance gave them, then 0."""
    names, edge, node, weight = arrays
    start = {r.node: r.u for r in first.collect()}  # nodes of bounded incidences, and those without any
    alone = [x for x in start if x not in set(names)]
    u = np.array([start[x] for x in [*names, *alone]], dtype=float).reshape(-1, k)
    n, n_edges, inside = len(names), len(weight), slice(0, len(names))
    # incidences lie edge by edge: sums over an edge are over a stretch; u'wu is linear in the products of two memberships
    starts, counts = np.flatnonzero(np.diff(edge, prepend=-1)), np.bincount(edge, minlength=n_edges)
    of_edge = lambda x: np.add.reduceat(x[node], starts)

    def squares(u: np.ndarray) -> np.ndarray:
        out = np.empty((k, k, n_edges))
        for a in range(k):
            for b in range(a, k):
                out[a, b] = out[b, a] = of_edge(u[:, a] * u[:, b])
        return out

    def rates(s: np.ndarray, own: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.maximum((np.einsum("ai,ab,bi->i", s, w, s, optimize=True) - np.einsum("ab,abi->i", w, own)) / 2, 1e-300)

    rounds = 0
    for rounds in range(1, n_iter + 1):
        s, own = np.stack([of_edge(u[:, a]) for a in range(k)]), squares(u)
        m = weight / rates(s, own, w)
        bm = np.bincount(node, np.repeat(m, counts), n)
        top = (s * m) @ s.T - u[inside].T @ (bm[:, None] * u[inside])
        total = u.sum(0)
        new_w = 0.5 * w * top / (0.5 * (np.outer(total, total) - u.T @ u) + w_prior)
        new_w = np.diag(np.diag(new_w)) if assortative else (new_w + new_w.T) / 2
        m = weight / rates(s, own, new_w)
        bm = np.bincount(node, np.repeat(m, counts), n)
        up = np.zeros_like(u)
        near = np.stack([np.bincount(node, np.repeat(m * s[a], counts), n) for a in range(k)], 1)
        up[inside] = (near - bm[:, None] * u[inside]) @ new_w
        down = total @ new_w - u @ new_w + u_prior
        new_u = np.divide(u * np.maximum(up, 0.0), down, out=np.zeros_like(u), where=down > 0)
        done = tolerance is not None and rounds % check_every == 0 and np.sqrt(((new_u - u) ** 2).sum()) / len(u) < tolerance and np.linalg.norm(new_w - w) / k < tolerance
        u, w = new_u, new_w
        if done:
            break
    total = u.sum(0)
    likelihood = -(total @ w @ total - (w * (u.T @ u)).sum()) / 2 + (weight * np.log(rates(np.stack([of_edge(u[:, a]) for a in range(k)]), squares(u), w))).sum()
    kind = edges.schema["nodes"].dataType.elementType.simpleString()
    found = edges.sparkSession.createDataFrame([(x, row.tolist()) for x, row in zip([*names, *alone], u)], f"node {kind}, u array<double>")
    return MixedMembership(found, w / size_factor(max_size), float(likelihood), rounds)


def mixed_log_likelihood(held: DataFrame, u: DataFrame, w: np.ndarray, k: int) -> float:
    """- sum over pairs of u_i' w u_j + sum of A_e log lambda_e."""
    total = np.array([x or 0.0 for x in u.agg(*[F.sum(F.col("u")[a]) for a in range(k)]).first()])
    own = _outer(u.withColumn("one", F.lit(1.0)), "u", "one", k)
    pairs = (total @ w @ total - (w * own).sum()) / 2
    return float(-pairs + (_edge_sums(held, u, w, k).agg(F.sum(F.col("weight") * F.log("lam"))).first()[0] or 0.0))


def expected_degree(u: DataFrame, w: np.ndarray, max_size: int) -> DataFrame:
    """``node`` and its expected degree, C-scaled: sum over j of u_i' w u_j times the sizes' factor 2 / (d - 1) / d * (d - 1)."""
    k = len(w)
    total = np.array([x or 0.0 for x in u.agg(*[F.sum(F.col("u")[a]) for a in range(k)]).first()])
    base = w @ total
    c = sum(2 / d for d in range(2, max_size + 1))
    own = sum((F.lit(float(w[a, b])) * F.col("u")[a] * F.col("u")[b] for a in range(k) for b in range(k)), F.lit(0.0))
    return u.select("node", ((sum((F.lit(float(base[a])) * F.col("u")[a] for a in range(k)), F.lit(0.0)) - own) * c).alias("degree"))


# -- model with one affinity per size


def _symmetric(values: np.ndarray, top: int) -> np.ndarray:
    """Elementary symmetric polynomials of degree 0..top of the rows of ``values``, per column."""
    e = np.zeros((top + 1, values.shape[1]))
    e[0] = 1.0
    for row in values:
        e[1:] = e[1:] + e[:-1] * row
    return e


def _size_model(edges: list[tuple[list[int], float]], n: int, k: int, seed: int, max_iter: int, tolerance: float, patience: int, normalize: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """One realization of the per-size model; nodes are updated one after another, in an order drawn anew each round."""
    rng = np.random.default_rng(seed)
    top = max(len(e) for e, _ in edges)
    u, w = rng.random((n, k)), rng.random((top + 1, k))
    of_node: list[list[int]] = [[] for _ in range(n)]
    for j, (e, _) in enumerate(edges):
        for x in e:
            of_node[x].append(j)
    weight, sizes = np.array([a for _, a in edges]), np.array([len(e) for e, _ in edges])

    def clip(x: np.ndarray) -> np.ndarray:
        return np.where(x < 1e-5, 0.0, np.minimum(x, 100.0))

    of_size = [(np.flatnonzero(sizes == d), np.array([e for e, _ in edges if len(e) == d])) for d in np.unique(sizes)]

    def products() -> np.ndarray:
        out = np.empty((len(edges), k))
        for at, members in of_size:
            out[at] = w[members.shape[1]] * np.prod(u[members], axis=1)
        return out

    def shares() -> np.ndarray:
        rho = products()
        total = rho.sum(axis=1, keepdims=True)
        return np.divide(rho, total, out=np.zeros_like(rho), where=total > 0)

    def likelihood() -> float:
        psi = _symmetric(u, top)
        lam = products().sum(axis=1)
        return float(-(w[2:] * psi[2:]).sum() + (weight * np.log(lam + 1e-300)).sum())

    best, calm = likelihood(), 0
    for _ in range(max_iter):
        rho = shares()
        psi = _symmetric(u, top)
        for d in range(2, top + 1):
            w[d] = clip(np.divide((weight * (sizes == d)) @ rho, psi[d], out=np.zeros(k), where=psi[d] > 0))
        rho = shares()
        for i in rng.permutation(n):
            if not of_node[i]:
                u[i] = 0.0
                continue
            without = np.zeros_like(psi)  # polynomials of all others
            full = _symmetric(u, top)
            without[0] = 1.0
            for d in range(1, top + 1):
                without[d] = np.maximum(full[d] - u[i] * without[d - 1], 0.0)
            down = sum(w[d] * without[d - 1] for d in range(2, top + 1))
            up = weight[of_node[i]] @ rho[of_node[i]]
            new = np.divide(up, down, out=np.zeros(k), where=down > 0)
            u[i] = new / new.sum() if normalize and new.sum() > 0 else clip(new)
        now = likelihood()
        calm = calm + 1 if abs(now - best) < tolerance else 0
        best = now
        if calm > patience:
            break
    return u, w, best


def fit_size_model(edges: DataFrame, k: int, *, realizations: int = 10, max_iter: int = 500, tolerance: float = 0.1, patience: int = 15, normalize: bool = False, seed: int = 0, limit: int = 200_000) -> tuple[DataFrame, DataFrame, float]:
    """Memberships (``node``, ``u``), affinities (``size``, ``w``) and log-likelihood of the best of several realizations.

    The updates of one realization depend on each other, so each runs as one task, all in parallel; the
    edges are a parameter of every task, so there may be ``limit`` of them at most.
    """
    spark = edges.sparkSession
    rows = bounded_rows(edges.where("size >= 2").select("nodes", "weight"), limit, "edges of a per-size model")
    if not rows:
        raise InvalidParameterError("there are no edges of two or more nodes")
    names = sorted({x for r in rows for x in r.nodes})
    at = {x: j for j, x in enumerate(names)}
    data = sorted(([at[x] for x in r.nodes], float(r.weight)) for r in rows)
    shared = spark.sparkContext.broadcast(data)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for s in frame["seed"]:
                u, w, value = _size_model(shared.value, len(names), k, int(s), max_iter, tolerance, patience, normalize)
                out.append((int(s), u.ravel().tolist(), w.ravel().tolist(), value))
            yield pd.DataFrame(out, columns=["seed", "u", "w", "value"])

    seeds = spark.createDataFrame([(seed * 10_007 + r,) for r in range(realizations)], "seed bigint").repartition(realizations)
    best = cut(seeds.mapInPandas(run, "seed bigint, u array<double>, w array<double>, value double")).orderBy(F.desc("value"), "seed").first()
    u, w = np.array(best.u).reshape(len(names), k), np.array(best.w).reshape(-1, k)
    kind = dict(edges.select(F.explode("nodes").alias("node")).dtypes)["node"]
    memberships = spark.createDataFrame([(x, row.tolist()) for x, row in zip(names, u)], f"node {kind}, u array<double>")
    return memberships, spark.createDataFrame([(d, w[d].tolist()) for d in range(2, len(w))], "size int, w array<double>"), best.value


# -- spectral clustering


def _kmeans(x: np.ndarray, k: int, seed: int, starts: int = 10) -> np.ndarray:
    rng, best, labels = np.random.default_rng(seed), np.inf, np.zeros(len(x), int)
    for _ in range(starts):
        centers = x[[int(rng.integers(len(x)))]]
        while len(centers) < k:  # next centers far from the others
            d = ((x[:, None] - centers[None]) ** 2).sum(-1).min(1)
            p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
            centers = np.vstack([centers, x[rng.choice(len(x), p=p)]])
        for _ in range(100):
            now = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
            new = np.array([x[now == c].mean(0) if (now == c).any() else centers[c] for c in range(k)])
            if np.allclose(new, centers):
                break
            centers = new
        cost = ((x - centers[now]) ** 2).sum()
        if cost < best - 1e-12:
            best, labels = cost, now
    return labels


def spectral_communities(edges: DataFrame, k: int, *, nodes: DataFrame | None = None, weighted: bool = False, seed: int = 0, limit: int = DENSE) -> DataFrame:
    """``node``, ``community`` (null for isolated nodes): k-means on eigenvectors 2..k of I - D^-1/2 H De^-1 H' D^-1/2.

    Spark makes the entries; the eigenproblem is dense and for at most ``limit`` nodes.
    """
    if k < 2:
        raise InvalidParameterError("k must be at least 2")
    w = F.col("weight") if weighted else F.lit(1.0)
    held = cut(edges.select("edge_id", F.size("nodes").alias("n"), w.alias("w"), F.explode("nodes").alias("node")))
    degree = held.groupBy("node").agg(F.sum("w").alias("d"))
    scaled = held.join(degree, "node").select("edge_id", "n", "node", (F.col("w") / F.sqrt("d")).alias("x"))
    a, b = (scaled.select("edge_id", "n", F.col("node").alias(name), F.col("x").alias(f"x_{name}")) for name in ("row", "col"))
    matrix = a.join(b, ["edge_id", "n"]).groupBy("row", "col").agg(F.sum(F.col("x_row") * F.col("x_col") / F.col("n")).alias("val"))
    names, h = dense(matrix, degree.select("node"), limit)
    values, vectors = np.linalg.eigh(np.eye(len(names)) - h)
    x = vectors[:, 1:k]
    x = x * np.where(np.take_along_axis(x, np.abs(x).argmax(0)[None], 0) < 0, -1.0, 1.0)
    labels = _kmeans(x, min(k, len(names)), seed)
    kind = dict(edges.select(F.explode("nodes").alias("node")).dtypes)["node"]
    found = edges.sparkSession.createDataFrame([(n, int(c)) for n, c in zip(names, labels)], f"node {kind}, community int")
    return node_table(edges, nodes).join(found, "node", "left")


# -- core-periphery


def core_profile(n: int, alpha: float, beta: float) -> np.ndarray:
    """Core values of ranks 1..n: a slow rise to the boundary at floor(beta n), then a jump of alpha and a rise to 1."""
    i, b = np.arange(1, n + 1, dtype=float), math.floor(beta * n)
    low = i * (1 - alpha) / (2 * b) if b else np.zeros(n)
    high = (i - b) * (1 - alpha) / (2 * (n - b)) + (1 + alpha) / 2 if n > b else np.ones(n)
    return np.where(i <= b, low, high)


def core_periphery(edges: DataFrame, *, rounds: int = 1000, greedy_start: bool = False, seed: int = 0) -> DataFrame:
    """``node``, ``coreness`` in 0..1: mean over rounds of the core values that hill-climbing gives, weighed by their quality.

    A round draws alpha and beta and swaps the ranks of two nodes 10 N times wherever the quality, the
    sum of w / |e| times the core values of the edge's nodes, rises. The quality is linear in the core values,
    so rounds need one number per node, which Spark sums over any number of edges. They are independent and run
    as parallel tasks.
    """
    spark = edges.sparkSession
    of_size = edges.select(F.explode("nodes").alias("node"), F.size("nodes").alias("size"), "weight").groupBy("node", "size").agg(F.sum("weight").alias("w"))
    # added up in the order of the sizes, so that the numbers are the same however rows are spread
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("size", "w"))), F.lit(0.0), lambda s, x: s + x["w"] / x["size"])
    rows = sorted((r.node, r.pull) for r in of_size.groupBy("node").agg(whole.alias("pull")).collect())  # a row per node, as in the result
    if not rows:
        raise InvalidParameterError("there are no edges")
    names, pull = [x for x, _ in rows], np.array([p for _, p in rows])
    degree_order = np.argsort(np.argsort(pull, kind="stable"), kind="stable")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = len(pull)
        for frame in frames:
            total, weight = np.zeros(n), 0.0
            for s in frame["id"]:
                rng = np.random.default_rng([seed, int(s)])
                values = core_profile(n, rng.random(), rng.random())
                rank = degree_order.copy() if greedy_start else rng.permutation(n)
                for i, j in rng.integers(n, size=(10 * n, 2)):
                    if (pull[i] - pull[j]) * (values[rank[j]] - values[rank[i]]) > 0:
                        rank[i], rank[j] = rank[j], rank[i]
                quality = float(pull @ values[rank])
                total += values[rank] * quality
                weight += quality
            yield pd.DataFrame({"part": [total.tolist()]})

    tasks = spark.range(rounds, numPartitions=min(rounds, 64))
    summed = tasks.mapInPandas(run, "part array<double>").select(F.posexplode("part").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    scores = {r.k: r.x for r in summed.collect()}  # a number per node of a bounded model
    top = max(scores.values(), default=0.0) or 1.0
    kind = dict(edges.select(F.explode("nodes").alias("node")).dtypes)["node"]
    return spark.createDataFrame([(x, scores.get(j, 0.0) / top) for j, x in enumerate(names)], f"node {kind}, coreness double")


# -- clustering of edges


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of average linkage; new clusters are numbered from n on."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, name, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    out = []
    for step in range(n - 1):
        k = int(np.argmin(d))
        i, j = divmod(k, n)
        i, j = min(i, j), max(i, j)
        a, b = sorted((int(name[i]), int(name[j])))
        out.append((a, b, float(d[i, j]), int(size[i] + size[j])))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i] = n + step
        alive[j] = False
    return out


def cut_dendrogram(merges: list[tuple[int, int, float, int]], n: int, height: float) -> np.ndarray:
    """Cluster labels 0.. in order of first appearance after all merges up to ``height``."""
    parent = list(range(n + len(merges)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (a, b, h, _) in enumerate(merges):
        if h <= height:
            parent[root(a)] = parent[root(b)] = n + k
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(root(x), len(seen)) for x in range(n)])


def edge_communities(edges: DataFrame, height: float, *, limit: int = 5_000) -> DataFrame:
    """``edge_id``, ``community``: average linkage of the edges by Jaccard distance (1 without a common node), cut at ``height``.

    The distances of edges that share a node are made by a join; the dendrogram is built on the driver for
    at most ``limit`` edges, to which the largest component of a hypergraph should be narrowed first.
    """
    ids = sorted(r.edge_id for r in bounded_rows(edges.select("edge_id"), limit, "edges of a dendrogram"))
    at = {x: k for k, x in enumerate(ids)}
    d = np.ones((len(ids), len(ids)))
    for r in bounded_rows(line_graph(edges, distance="jaccard", s=0), limit * limit, "pairs of edges"):
        d[at[r.edge_a], at[r.edge_b]] = d[at[r.edge_b], at[r.edge_a]] = 1 - r.w
    labels = cut_dendrogram(average_linkage(d), len(ids), height) if ids else []
    return edges.sparkSession.createDataFrame([(x, int(c)) for x, c in zip(ids, labels)], "edge_id bigint, community int")


def overlapping_communities(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """``node``, ``communities``: those of its edges, ascending."""
    held = edges.select("edge_id", F.explode("nodes").alias("node")).join(communities, "edge_id")
    return held.groupBy("node").agg(F.array_sort(F.collect_set("community")).alias("communities"))


def matching(reference: np.ndarray, predicted: np.ndarray) -> list[int]:
    """Greedy permutation of the predicted communities onto the reference's, largest overlap first."""
    overlap = np.asarray(reference, float).T @ np.asarray(predicted, float)
    k = overlap.shape[1]
    to = [-1] * k
    for _ in range(k):
        a, b = divmod(int(np.argmax(overlap)), k)
        to[b] = a
        overlap[a, :], overlap[:, b] = -np.inf, -np.inf
    return to
