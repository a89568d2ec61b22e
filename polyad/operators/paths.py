"""Components, reach, shortest paths, and centralities of paths.

Loops run on tables: every round is cut, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.operators.edges import by_size, node_table
from polyad.operators.projections import node_pairs
from polyad.runtime import Rounds, bounded_rows, cut

#: Vertices and links of a graph up to which measures of all pairs of vertices are computed.
ALL_PAIRS = 50_000
ALL_LINKS = 5_000_000
#: Nodes up to which the incidences go to the tasks as a dense matrix, from which paths are counted in blocks of sources;
#: edges that such a matrix may have, and edges up to which paths over overlaps, whose links aren't factors of it, are counted.
DENSE_NODES = 128
DENSE_EDGES = 200_000
OVERLAP_EDGES = 20_000
#: Nodes up to which edges are counted in a table of all sets of nodes (2 ** MASK_NODES numbers in a task).
MASK_NODES = 26


def _mark(links: DataFrame) -> tuple:
    """Number and combined hash of a set of links: equal sets have equal marks."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, *, order: int | None = None, size: int | None = None) -> DataFrame:
    """``node`` and ``component``, the least node that it is connected with; a node without edges is its own.

    Large-star and small-star steps on links from each edge's nodes to its least node: links only ever
    lead to smaller nodes, so rounds grow with the logarithm of the longest path, not with its length.
    """
    every = cut(node_table(edges, nodes))
    used = by_size(edges, order=order, size=size)
    links = used.select(F.explode("nodes").alias("u"), F.array_min("nodes").alias("v")).where("u != v").distinct()
    rounds = Rounds()
    links = rounds.cut(links)
    before = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbor is linked to the least of the neighborhood
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbors are linked to the least of them
        down = large.where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = rounds.cut(small)
        if (now := _mark(links)) == before:
            break
        before = now
    return every.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    """``component`` and ``n_nodes``."""
    return components.groupBy("component").agg(F.count("*").alias("n_nodes"))


def largest_component(components: DataFrame) -> DataFrame:
    """The nodes of the largest component; of several, the one with the least node."""
    best = component_sizes(components).orderBy(F.desc("n_nodes"), "component").limit(1)
    return components.join(best.select("component"), "component", "left_semi").select("node")


def is_connected(components: DataFrame) -> bool:
    return component_sizes(components).limit(2).count() == 1


def reach(edges: DataFrame, starts: DataFrame, *, max_depth: int | None = None, order: int | None = None, size: int | None = None) -> DataFrame:
    """``node`` and ``hops`` from the nearest of ``starts`` (``node``), up to ``max_depth``.

    A round goes from the frontier to its edges and on to their nodes, so no table of node pairs is made.
    """
    held = cut(by_size(edges, order=order, size=size).select("edge_id", F.explode("nodes").alias("node")))
    whole, fronts = Rounds(), Rounds()
    found = whole.cut(starts.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier, depth = found.select("node"), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        met = held.join(frontier, "node", "left_semi").select("edge_id").distinct()
        new = fronts.cut(held.join(met, "edge_id", "left_semi").select("node").distinct().join(found.select("node"), "node", "left_anti"))
        if new.isEmpty():
            break
        found = whole.cut(found.unionByName(new.withColumn("hops", F.lit(depth))))
        frontier = new
    return found


def graph_distances(links: DataFrame, *, max_hops: int | None = None) -> DataFrame:
    """``a``, ``b``, ``hops``, ``paths``: hops and number of shortest paths between all different connected nodes of an undirected graph.

    ``links`` has every link in both directions (``a``, ``b``). The result has a row for every ordered
    pair: meant for graphs whose pairs can be stored.
    """
    links = cut(links.select("a", "b").distinct())
    whole, steps = Rounds(), Rounds()
    found = whole.cut(links.select("a", "b", F.lit(1).alias("hops"), F.lit(1).cast("double").alias("paths")))
    step, hops = found, 1
    while max_hops is None or hops < max_hops:
        hops += 1
        ahead = step.select("a", F.col("b").alias("via"), "paths").join(links.withColumnsRenamed({"a": "via"}), "via").where("a != b")
        new = ahead.groupBy("a", "b").agg(F.sum("paths").alias("paths")).join(found.select("a", "b"), ["a", "b"], "left_anti")
        step = steps.cut(new.select("a", "b", F.lit(hops).alias("hops"), "paths"))
        if step.isEmpty():
            break
        found = whole.cut(found.unionByName(step))
    return found


def _sweep(starts: np.ndarray, ends: np.ndarray, n: int, source: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hops and numbers of shortest paths from one vertex, and the vertices by hops; ``ends[starts[v]:starts[v + 1]]`` are v's neighbors."""
    hops, paths = np.full(n, -1), np.zeros(n)
    hops[source], paths[source] = 0, 1.0
    levels = [np.array([source])]
    while len(levels[-1]):
        here = levels[-1]
        counts = starts[here + 1] - starts[here]
        at = np.repeat(starts[here] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        to, via = ends[at], np.repeat(here, counts)
        fresh = hops[to] < 0
        found = np.unique(to[fresh])
        np.add.at(paths, to[fresh], paths[via[fresh]])
        hops[found] = len(levels)
        levels.append(found)
    return hops, paths, levels[:-1]


def _scores(starts: np.ndarray, ends: np.ndarray, n: int, sources: np.ndarray, measure: str) -> np.ndarray:
    """Closeness of the sources, or the sources' part of every vertex' betweenness."""
    out = np.zeros(n)
    for source in sources:
        hops, paths, levels = _sweep(starts, ends, n, source)
        if measure == "closeness":
            seen = hops > 0
            if seen.any():
                out[source] = seen.sum() / hops[seen].sum() * seen.sum() / max(1, n - 1)
            continue
        delta = np.zeros(n)
        for level in reversed(levels[1:]):  # from the farthest inward
            counts = starts[level + 1] - starts[level]
            at = np.repeat(starts[level] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            to, via = ends[at], np.repeat(level, counts)
            inner = hops[to] == hops[via] - 1
            to, via = to[inner], via[inner]
            np.add.at(delta, to, paths[to] / paths[via] * (1 + delta[via]))
        delta[source] = 0.0
        out += delta
    return out


def _path_scores(links: DataFrame, nodes: DataFrame, measure: str, *, prefix: str = "") -> DataFrame:
    """``a`` and its closeness or betweenness in an undirected graph (``a``, ``b`` once per link).

    Closeness is (r / total hops) * (r / (n - 1)) with r vertices reached; betweenness the share of
    shortest paths between two others, by (n - 1)(n - 2) / 2. Both need all pairs, so the graph is
    bounded (``ALL_PAIRS`` vertices, ``ALL_LINKS`` links, checked); it goes to every task, and the
    sources are spread over the tasks. With a ``prefix``, closeness is of the vertices that begin with
    it: only these are sources and bounded by ``ALL_PAIRS``.
    """
    if measure not in ("closeness", "betweenness"):
        raise InvalidParameterError(f"unknown measure: {measure}")
    spark = links.sparkSession
    few = bool(prefix) and measure == "closeness"
    names = sorted(r.node for r in bounded_rows(nodes.select("node"), DENSE_EDGES if few else ALL_PAIRS, "vertices of an all-pairs measure"))
    kind = dict(nodes.select(F.col("node")).dtypes)["node"]
    if not names:
        return nodes.select(F.col("node").alias("a"), F.lit(0.0).alias(measure)).limit(0)
    at = {x: k for k, x in enumerate(names)}
    rows = bounded_rows(links.select("a", "b"), ALL_LINKS, "links of an all-pairs measure")
    pairs = np.array([(at[r.a], at[r.b]) for r in rows], dtype=np.int64).reshape(-1, 2)
    both = np.unique(np.vstack([pairs, pairs[:, ::-1]]), axis=0)
    n = len(names)
    starts = np.searchsorted(both[:, 0], np.arange(n + 1))
    shared = spark.sparkContext.broadcast((starts, both[:, 1].copy()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, ends = shared.value
        for frame in frames:
            scores = _scores(starts, ends, n, frame["id"].to_numpy(), measure)
            hit = np.flatnonzero(scores)
            yield pd.DataFrame({"k": hit, "x": scores[hit]})

    sources = [k for k, x in enumerate(names) if x.startswith(prefix)] if few else range(n)
    if len(sources) > ALL_PAIRS:
        raise InvalidParameterError(f"sources of a closeness: more than {ALL_PAIRS}; this step needs a bounded input")
    ids = spark.createDataFrame([(k,) for k in sources], "id bigint").repartition(max(1, min(len(sources), 64))) if few else spark.range(n, numPartitions=min(n, 64))
    parts = ids.mapInPandas(run, "k bigint, x double")
    scale = (n - 1) * (n - 2) if measure == "betweenness" and n > 2 else 1
    summed = parts.groupBy("k").agg((F.sum("x") / scale).alias(measure))
    named = spark.createDataFrame(list(enumerate(names)), f"k bigint, a {kind}")
    return named.join(summed, "k", "left").select("a", F.coalesce(measure, F.lit(0.0)).alias(measure))


def _incidence(edges: DataFrame) -> tuple[list, list, np.ndarray] | None:
    """Edges, nodes and their dense incidence matrix; None if there are more than ``DENSE_NODES`` nodes or ``DENSE_EDGES`` edges."""
    names = sorted(r.node for r in edges.select(F.explode("nodes").alias("node")).distinct().take(DENSE_NODES + 1))
    if not names or len(names) > DENSE_NODES:
        return None
    rows = sorted((r.edge_id, r.nodes) for r in edges.select("edge_id", "nodes").take(DENSE_EDGES + 1))
    if len(rows) > DENSE_EDGES:
        return None
    at = {x: k for k, x in enumerate(names)}
    held = np.zeros((len(rows), len(names)), dtype=np.uint8)
    for k, (_, nodes) in enumerate(rows):
        held[k, [at[x] for x in nodes]] = 1
    return [x for x, _ in rows], names, held


def _shares(first: np.ndarray, step, out: list[np.ndarray]) -> None:
    """Adds a block of sources' part to every vertex' betweenness.

    ``first`` has a row per source. Levels alternate between the kinds of vertices that ``out`` has (one or
    two); ``step(x, kind, need)`` is x times the adjacency from that kind to the next, right where ``need``.
    """
    kinds = len(out)
    seen = [np.zeros((len(first), len(x)), dtype=bool) for x in out]
    levels = [first]
    seen[0] |= first > 0
    while True:
        kind = len(levels) % kinds
        new = step(levels[-1], (len(levels) - 1) % kinds, ~seen[kind])
        new[seen[kind]] = 0.0
        if not new.any():
            break
        seen[kind] |= new > 0
        levels.append(new)
    delta = np.zeros_like(levels[-1])
    for k in range(len(levels) - 1, 0, -1):
        out[k % kinds] += delta.sum(0)
        share = np.divide(1 + delta, levels[k], out=np.zeros_like(delta), where=levels[k] > 0)
        delta = levels[k - 1] * step(share, k % kinds, levels[k - 1] > 0)


def _overlap_step(h: np.ndarray, s: float):
    """Products with the adjacency of overlaps of at least ``s``, made in blocks of columns."""

    def step(x: np.ndarray, kind: int, need: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        rows, columns = np.flatnonzero(x.any(0)), np.flatnonzero(need.any(0))
        x, own = x[:, rows], h[rows]
        for k in range(0, len(columns), 512):
            part = columns[k : k + 512]
            out[:, part] = x @ (own @ h[part].T >= s).astype(float)
        return out

    return step


def _both_step(h: np.ndarray):
    """Products with the incidences: kind 0 leads from edges to nodes."""
    return lambda x, kind, need: x @ h if kind == 0 else x @ h.T


def _block_closeness(h: np.ndarray, block: np.ndarray, s: float) -> np.ndarray:
    """Closeness of a block of edges by overlaps of at least ``s``; for one common node, steps lead over the nodes."""
    n = len(h)
    seen = np.zeros((len(block), n), dtype=bool)
    seen[np.arange(len(block)), block] = True
    fresh, hops, total = seen.copy(), 0, np.zeros(len(block))
    step = _overlap_step(h, s)
    while fresh.any():
        hops += 1
        fresh = (((fresh.astype(h.dtype) @ h > 0).astype(h.dtype) @ h.T) if s == 1 else step(fresh.astype(float), 0, ~seen)) > 0
        fresh &= ~seen
        seen |= fresh
        total += hops * fresh.sum(1)
    reached = seen.sum(1) - 1.0
    return np.divide(reached * reached, total * max(1, n - 1), out=np.zeros(len(block)), where=total > 0)


def _dense_scores(edges: DataFrame, found: tuple[list, list, np.ndarray], measure: str, of: str, s: float = 1) -> DataFrame:
    """Path scores from a dense incidence matrix: of ``edge`` by overlaps, or the betweenness of ``node`` in the bipartite graph."""
    spark = edges.sparkSession
    ids, nodes, held = found
    n_edges, n_nodes = held.shape
    shared = spark.sparkContext.broadcast(held)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = shared.value.astype(np.float32 if measure == "closeness" else float)
        size = max(1, 4_000_000 // n_edges)
        out = [np.zeros(n_edges)] if of == "edge" else [np.zeros(n_edges), np.zeros(n_nodes)]
        for frame in frames:
            every = frame["id"].to_numpy()
            # sources beyond the edges are nodes
            for kind, sources in enumerate((every[every < n_edges], every[every >= n_edges] - n_edges)):
                for k in range(0, len(sources), size):
                    block = sources[k : k + size]
                    if measure == "closeness":
                        out[0][block] = _block_closeness(h, block, s)
                        continue
                    first = np.zeros((len(block), held.shape[kind]))
                    first[np.arange(len(block)), block] = 1.0
                    if of == "edge":
                        _shares(first, _overlap_step(h, s), out)
                    elif kind == 0:
                        _shares(first, _both_step(h), out)
                    else:
                        _shares(first, _both_step(h.T), out[::-1])
        hit = np.flatnonzero(out[-1])
        yield pd.DataFrame({"k": hit, "x": out[-1][hit]})

    names = ids if of == "edge" else nodes
    n = n_edges if of == "edge" else n_edges + n_nodes
    parts = spark.range(n, numPartitions=min(n, 64)).mapInPandas(run, "k bigint, x double")
    scale = (n - 1) * (n - 2) if measure == "betweenness" and n > 2 else 1
    summed = parts.groupBy("k").agg((F.sum("x") / scale).alias(measure))
    kind = edges.schema["edge_id"].dataType.simpleString() if of == "edge" else edges.schema["nodes"].dataType.elementType.simpleString()
    named = spark.createDataFrame(list(enumerate(names)), f"k bigint, a {kind}")
    return named.join(summed, "k", "left").select("a", F.coalesce(measure, F.lit(0.0)).alias(measure))


def _node_hops(edges: DataFrame, most: int) -> tuple[list, np.ndarray] | None:
    """Nodes in order and the hops between them over common edges, infinite where there is no way; None if there are more than ``most`` nodes or none."""
    names = sorted(r.node for r in edges.select(F.explode("nodes").alias("node")).distinct().take(most + 1))
    if not names or len(names) > most:
        return None
    at, near = {x: k for k, x in enumerate(names)}, np.eye(len(names), dtype=bool)
    for r in node_pairs(edges).select("a", "b").distinct().collect():  # pairs of few nodes
        near[at[r.a], at[r.b]] = near[at[r.b], at[r.a]] = True
    hops = np.where(np.eye(len(names), dtype=bool), 0.0, np.inf)
    reached, k = np.eye(len(names), dtype=bool), 0
    while True:
        k += 1
        new = (reached.astype(int) @ near > 0) & ~reached
        if not new.any():
            return names, hops
        hops[new] = k
        reached |= new


def _few_nodes_closeness(edges: DataFrame) -> DataFrame | None:
    """Closeness of few nodes in the bipartite graph with any number of edges; None if there are more than ``DENSE_NODES`` nodes.

    An edge is 2 m + 1 hops from a node, m being the least number of hops over common edges to one of its nodes, so
    one pass over the edges, which stay where they are, gives each node's sums.
    """
    found = _node_hops(edges, DENSE_NODES)
    if found is None:
        return None
    names, hops = found
    index = pd.Index(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, reached = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            lists = batch.column(0)
            if not len(lists):
                continue
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())[:-1]]).astype(np.int64)
            least = np.minimum.reduceat(hops[:, index.get_indexer(lists.flatten().to_pandas())], starts, axis=1)
            there = np.isfinite(least)
            total += np.where(there, 2 * least + 1, 0).sum(1).astype(np.int64)
            reached += there.sum(1)
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(names)), "total": total, "reached": reached})

    used = edges.where("size(nodes) > 0").select("nodes")
    parts = used.mapInArrow(run, "k bigint, total bigint, reached bigint").groupBy("k").agg(F.sum("total").alias("total"), F.sum("reached").alias("reached"))
    n = len(names) + used.count()
    sums = {r.k: (r.total, r.reached) for r in parts.collect()}  # a row per node
    ways = np.isfinite(hops)
    rows = []
    for k, name in enumerate(names):
        reached = sums[k][1] + int(ways[k].sum()) - 1
        rows.append((str(name), reached / (sums[k][0] + 2 * float(hops[k][ways[k]].sum())) * reached / max(1, n - 1)))
    return edges.sparkSession.createDataFrame(rows, "node string, closeness double")


def _mask_closeness(edges: DataFrame) -> DataFrame | None:
    """Closeness of edges in the line graph of common nodes, for few nodes and any number of edges; None if there are more than ``MASK_NODES`` nodes.

    What is reached from an edge within k + 1 hops are the edges that meet the nodes within k hops of it: all but
    those inside the rest of the nodes. A table of all sets of nodes, summed up over the subsets, has their
    number, so an edge needs one look per hop and no two edges are compared.
    """
    found = _node_hops(edges, MASK_NODES)
    if found is None:
        return None
    names, hops = found
    full = (1 << len(names)) - 1
    near = [sum(1 << int(j) for j in np.flatnonzero(row <= 1)) for row in hops]
    bits = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, 1 << k)])
    masked = cut(edges.select("edge_id", F.aggregate("nodes", F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(F.element_at(bits, x).cast("bigint"))).alias("mask")))
    held = masked.groupBy("mask").agg(F.count("*").alias("n")).toArrow()  # at most 2 ** MASK_NODES sets
    masks, counts = (held.column(c).to_numpy() for c in ("mask", "n"))
    n = int(counts.sum())
    shared = edges.sparkSession.sparkContext.broadcast((masks, counts.astype(np.int32 if n < 1 << 31 else np.int64)))
    kind = edges.schema["edge_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = None
        for batch in batches:
            if inside is None:
                masks, counts = shared.value
                inside = np.zeros(1 << len(names), dtype=counts.dtype)
                inside[masks] = counts
                for k in range(len(names)):
                    halves = inside.reshape(-1, 2, 1 << k)
                    halves[:, 1] += halves[:, 0]
            ball = batch.column(1).to_numpy()
            seen, total, k = np.ones(len(ball), dtype=np.int64), np.zeros(len(ball)), 0
            while True:
                k += 1
                now = np.maximum(n - inside[full & ~ball].astype(np.int64), seen)
                if (now == seen).all():
                    break
                total, seen = total + k * (now - seen), now
                ball = np.bitwise_or.reduce([np.where(ball >> j & 1, near[j], 0) for j in range(len(names))])
            reached = seen - 1.0
            score = np.divide(reached * reached, total * max(1, n - 1), out=np.zeros(len(ball)), where=total > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["edge_id", "closeness"])

    return masked.mapInArrow(run, f"edge_id {kind}, closeness double")


def edge_path_scores(edges: DataFrame, measure: str, *, s: float = 1) -> DataFrame:
    """``edge_id`` and its closeness or betweenness in the line graph of overlaps of at least ``s``.

    Over few nodes the overlaps are made from the incidences in blocks of sources and no link is stored.
    """
    from polyad.operators.projections import line_graph

    if s == 1 and measure == "closeness" and edges.count() > OVERLAP_EDGES and (few := _mask_closeness(edges)) is not None:
        return few
    found = _incidence(edges) if measure in ("closeness", "betweenness") and s >= 1 else None
    if found is not None:
        if (s == 1 and measure == "closeness") or len(found[0]) <= OVERLAP_EDGES:
            return _dense_scores(edges, found, measure, "edge", s).withColumnRenamed("a", "edge_id")
        degree = found[2].sum(0, dtype=np.int64)
        if (degree * (degree - 1) // 2).sum() > ALL_LINKS:
            raise InvalidParameterError(f"edges of paths over overlaps: more than {OVERLAP_EDGES}; this step needs a bounded input")
    links = line_graph(edges, s=s).select(F.col("edge_a").alias("a"), F.col("edge_b").alias("b"))
    return _path_scores(links, edges.select(F.col("edge_id").alias("node")), measure).withColumnRenamed("a", "edge_id")


def node_path_scores(edges: DataFrame, measure: str) -> DataFrame:
    """``node`` and its closeness or betweenness in the bipartite graph of nodes and edges."""
    found = _incidence(edges) if measure == "betweenness" else None
    if found is not None:
        return _dense_scores(edges, found, measure, "node").select(F.col("a").cast("string").alias("node"), measure)
    if measure == "closeness" and (few := _few_nodes_closeness(edges)) is not None:
        return few
    named = edges.select("edge_id", F.explode("nodes").alias("node"))
    held = named.select(F.concat(F.lit("N"), F.col("node").cast("string")).alias("a"), F.concat(F.lit("E"), F.col("edge_id").cast("string")).alias("b"))
    vertices = held.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    scored = _path_scores(held, vertices, measure, prefix="N").where("a LIKE 'N%'")
    return scored.select(F.substring("a", 2, 1_000_000).alias("node"), measure)


def averaged_path_scores(edges: DataFrame, measure: str, *, of: str = "edge", s: float = 1) -> DataFrame:
    """Path scores of every time of a temporal hypergraph, summed per edge (its nodes) or node and divided by the number of times.

    Whoever is absent at a time counts 0 there. All times are scored in one job, each by one task from its
    own links; a time may have ``ALL_PAIRS`` vertices and ``ALL_LINKS`` links at most, which is checked.
    """
    if of not in ("edge", "node"):
        raise InvalidParameterError("scores are of edge or node")
    if measure not in ("closeness", "betweenness"):
        raise InvalidParameterError(f"unknown measure: {measure}")
    name = F.array_join(F.col("nodes").cast("array<string>"), "|")
    held = cut(edges.select("time", name.alias("edge"), F.explode("nodes").alias("node")))
    if of == "edge":
        a, b = (held.select("time", "node", F.col("edge").alias(x)) for x in "ab")
        links = a.join(b, ["time", "node"]).where("a < b").groupBy("time", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= s).select("time", "a", "b")
        vertices = held.select("time", F.col("edge").alias("v")).distinct()
    else:
        links = held.select("time", F.concat(F.lit("N"), F.col("node").cast("string")).alias("a"), F.concat(F.lit("E"), F.col("edge")).alias("b"))
        vertices = links.select("time", F.explode(F.array("a", "b")).alias("v")).distinct()
    links, vertices = cut(links), cut(vertices)
    times = vertices.groupBy("time").agg(F.count("*").alias("n"))
    n_times, most = times.agg(F.count("*"), F.max("n")).first()
    if not n_times:
        raise InvalidParameterError("there are no times")
    if most > ALL_PAIRS or (links.groupBy("time").count().agg(F.max("count")).first()[0] or 0) > ALL_LINKS:
        raise InvalidParameterError(f"a time has more than {ALL_PAIRS} vertices or {ALL_LINKS} links; this step needs bounded times")

    def score(points: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(points["v"].to_numpy(dtype=str))
        n = len(names)
        ends = np.stack([np.searchsorted(names, pairs[c].to_numpy(dtype=str)) for c in "ab"], 1).reshape(-1, 2)
        both = np.unique(np.vstack([ends, ends[:, ::-1]]), axis=0)
        found = _scores(np.searchsorted(both[:, 0], np.arange(n + 1)), both[:, 1].copy(), n, np.arange(n), measure)
        return pd.DataFrame({"v": names, "x": found / ((n - 1) * (n - 2) if measure == "betweenness" and n > 2 else 1)})

    scored = vertices.groupBy("time").cogroup(links.groupBy("time")).applyInPandas(score, "v string, x double")
    if of == "node":
        scored = scored.where("v LIKE 'N%'").select(F.substring("v", 2, 1_000_000).alias("v"), "x")
    return scored.groupBy(F.col("v").alias(of)).agg((F.sum("x") / n_times).alias(measure))


# -- higher-order shortest paths


def step_sizes(edges: DataFrame) -> DataFrame:
    """``a`` < ``b``: of the edges that hold both, the least, largest and mean size, and how many beyond the first (``redundancy``)."""
    pairs = node_pairs(edges).groupBy("a", "b")
    return pairs.agg(F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size"), (F.count("*") - 1).alias("redundancy"))


def shortest_paths(edges: DataFrame, *, option: str = "min", max_hops: int | None = None) -> DataFrame:
    """Between all ordered pairs of connected nodes: ``a``, ``b``, ``hops``, ``path``, ``sizes``, ``redundancies`` and ``mean_size``.

    Paths run over the clique graph; of several shortest ones the lexicographically least is taken.
    Every step has the min, max or mean size of the edges that hold it, and its redundancy.
    """
    if option not in ("min", "max", "mean"):
        raise InvalidParameterError("option is min, max or mean")
    steps = step_sizes(edges).select("a", "b", F.col(f"{option}_size").cast("double").alias("size"), "redundancy")
    links = cut(steps.unionByName(steps.select(F.col("b").alias("a"), F.col("a").alias("b"), "size", "redundancy")))
    rounds, steps = Rounds(), Rounds()
    found = rounds.cut(links.select("a", "b", F.lit(1).alias("hops"), F.array("a", "b").alias("path"), F.array("size").alias("sizes"), F.array("redundancy").alias("redundancies")))
    step, hops = found, 1
    while max_hops is None or hops < max_hops:
        hops += 1
        ahead = step.withColumnRenamed("b", "via").join(links.withColumnsRenamed({"a": "via"}), "via").where("a != b")
        ahead = ahead.join(found.select("a", "b"), ["a", "b"], "left_anti")
        whole = F.struct(F.concat("path", F.array("b")).alias("path"), F.concat("sizes", F.array("size")).alias("sizes"), F.concat("redundancies", F.array("redundancy")).alias("redundancies"))
        best = ahead.groupBy("a", "b").agg(F.min(whole).alias("best"))
        step = steps.cut(best.select("a", "b", F.lit(hops).alias("hops"), "best.*"))
        if step.isEmpty():
            break
        found = rounds.cut(found.unionByName(step))
    mean = F.aggregate("sizes", F.lit(0.0), lambda s, x: s + x) / F.size("sizes")
    return found.withColumn("mean_size", mean)


def projected_paths(edges: DataFrame, *, option: str = "min", max_hops: int | None = None) -> DataFrame:
    """``shortest_paths`` of all edges, of pairs only and of larger edges only, told apart by ``projection``."""
    views = (("all", edges), ("dyads", edges.where("size = 2")), ("higher", edges.where("size >= 3")))
    parts = [shortest_paths(view, option=option, max_hops=max_hops).withColumn("projection", F.lit(name)) for name, view in views]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def dyadic_share(paths: DataFrame) -> DataFrame:
    """``hops``, ``n_paths``, ``dyadic``: per path length, the share of paths whose every step is a pair."""
    pure = F.forall("sizes", lambda x: x == 2).cast("int")
    return paths.groupBy("hops").agg(F.count("*").alias("n_paths"), F.avg(pure).alias("dyadic"))


def redundancy_by_length(paths: DataFrame) -> DataFrame:
    """``hops``, ``mean``, ``std`` (of the population) and ``n`` of the mean redundancy along paths."""
    mean = F.aggregate("redundancies", F.lit(0.0), lambda s, x: s + x) / F.size("redundancies")
    return paths.withColumn("r", mean).groupBy("hops").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.count("*").alias("n"))


# -- temporal paths


def supra_adjacency(edges: DataFrame) -> DataFrame:
    """``time``, ``node``, ``to_time``, ``to_node``, ``delay``: arcs of the time-unfolded graph.

    A node at one of its active times leads to its own next active time, and at every time to the next
    active time of each neighbor of then. ``next`` is found by a lead over each node's times.
    """
    active = edges.select("time", F.explode("nodes").alias("node")).distinct()
    coming = active.withColumn("to_time", F.lead("time").over(Window.partitionBy("node").orderBy("time")))
    own = coming.where("to_time IS NOT NULL").select("time", "node", "to_time", F.col("node").alias("to_node"))
    both = edges.select("time", "nodes", F.explode("nodes").alias("node")).select("time", "node", F.explode("nodes").alias("to_node")).where("node != to_node").distinct()
    across = both.join(coming.where("to_time IS NOT NULL").withColumnRenamed("node", "to_node"), ["time", "to_node"]).select("time", "node", "to_time", "to_node")
    return own.unionByName(across).distinct().withColumn("delay", F.col("to_time") - F.col("time"))


def temporal_paths(edges: DataFrame) -> DataFrame:
    """``a``, ``b``: the fastest (``delay``, then ``delay_hops``) and the shortest (``hops``, then ``hops_delay``) way in time between two nodes.

    A way starts at any active time of ``a`` and follows the arcs of ``supra_adjacency``; waiting at a node is a hop.
    """
    arcs = cut(supra_adjacency(edges))
    whole, fronts = Rounds(), Rounds()
    best = whole.cut(arcs.select(F.col("node").alias("a"), F.col("time").alias("t0"), F.col("to_node").alias("b"), F.col("to_time").alias("t"), F.lit(1).alias("hops")))
    front, hops = best, 1
    while True:
        hops += 1
        ahead = front.select("a", "t0", F.col("b").alias("node"), F.col("t").alias("time")).join(arcs, ["time", "node"])
        new = ahead.select("a", "t0", F.col("to_node").alias("b"), F.col("to_time").alias("t")).distinct().join(best.select("a", "t0", "b", "t"), ["a", "t0", "b", "t"], "left_anti")
        front = fronts.cut(new.withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            break
        best = whole.cut(best.unionByName(front))
    ways = best.where("a != b").withColumn("delay", F.col("t") - F.col("t0"))
    picked = ways.groupBy("a", "b").agg(F.min(F.struct("delay", "hops")).alias("fast"), F.min(F.struct("hops", "delay")).alias("short"))
    return picked.select("a", "b", F.col("fast.delay").alias("delay"), F.col("fast.hops").alias("delay_hops"), F.col("short.hops").alias("hops"), F.col("short.delay").alias("hops_delay"))
