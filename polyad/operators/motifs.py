"""Motifs of three and four nodes, undirected and directed.

A set of nodes has as its pattern all edges of at least two nodes inside it. Candidate sets come from
three passes that don't overlap: edges of N nodes; edges of N - 1 nodes with a smaller edge that adds one
node; sets connected by pairs alone. Patterns are bit masks over the possible edges, made canonical by a
table of all relabelings that is computed once and is of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cache
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.operators.generators import edge_swaps
from polyad.operators.projections import subsets_of_size
from polyad.runtime import cut


#: Randomized hypergraphs whose jobs are submitted at a time.
PARALLEL_RUNS = 4


@cache
def slots(n: int) -> tuple[tuple[int, ...], ...]:
    """The possible edges of n nodes, in the order of their bits."""
    return tuple(c for k in range(2, n + 1) for c in combinations(range(n), k))


@cache
def canonical_masks(n: int) -> dict[int, int]:
    """Each connected pattern that covers all n nodes, to the least mask among its relabelings."""
    bit = {c: k for k, c in enumerate(slots(n))}
    moves = [[bit[tuple(sorted(p[x] for x in c))] for c in slots(n)] for p in permutations(range(n))]
    out: dict[int, int] = {}
    for mask in range(1, 1 << len(bit)):
        if mask in out:
            continue
        parts = [set(c) for c, k in bit.items() if mask >> k & 1]
        whole, rest = set(parts[0]), parts[1:]
        while found := [p for p in rest if p & whole]:
            for p in found:
                whole |= p
                rest.remove(p)
        if rest or len(whole) < n:
            continue
        on = [k for k in range(len(bit)) if mask >> k & 1]
        orbit = {sum(1 << m[k] for k in on) for m in moves}
        least = min(orbit)
        out.update(dict.fromkeys(orbit, least))
    return out


def pattern_text(mask: int, n: int) -> str:
    """A pattern as its edges over the nodes 1..n."""
    return " ".join("".join(str(x + 1) for x in c) for k, c in enumerate(slots(n)) if mask >> k & 1)


def _candidate_sets(edges: DataFrame, n: int) -> DataFrame:
    """``nodes`` of every candidate set, once, with ``way``: how it was found first."""
    small = edges.where(F.col("size") <= n).select("edge_id", "nodes", "size")
    full = small.where(F.col("size") == n).select("nodes")
    held = small.select("edge_id", "size", "nodes", F.explode("nodes").alias("node"))
    if n == 3:
        a = held.where("size = 2").select(F.col("nodes").alias("x"), "node")
        b = held.where("size = 2").select(F.col("nodes").alias("y"), "node")
        grown = a.join(b, "node").where("x < y").select(F.array_sort(F.array_union("x", "y")).alias("nodes")).distinct()
        sets = full.select("nodes", F.lit(0).alias("way")).unionByName(grown.select("nodes", F.lit(2).alias("way")))
    else:
        a = held.where(F.col("size") == n - 1).select(F.col("nodes").alias("x"), "node")
        b = held.where(F.col("size") < n).select(F.col("nodes").alias("y"), "node")
        mid = a.join(b, "node").select(F.array_sort(F.array_union("x", "y")).alias("nodes")).where(F.size("nodes") == n).distinct()
        pairs = cut(small.where("size = 2").select(F.col("nodes")[0].alias("u"), F.col("nodes")[1].alias("v")))
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        grown = pairs.select(F.array("u", "v").alias("nodes"))
        for _ in range(n - 2):
            grown = grown.select("nodes", F.explode("nodes").alias("u")).join(both, "u").where(~F.array_contains("nodes", F.col("v")))
            grown = grown.select(F.array_sort(F.concat("nodes", F.array("v"))).alias("nodes")).distinct()
        sets = full.select("nodes", F.lit(0).alias("way")).unionByName(mid.select("nodes", F.lit(1).alias("way"))).unionByName(grown.select("nodes", F.lit(2).alias("way")))
    return sets.groupBy("nodes").agg(F.min("way").alias("way"))


def count_motifs(edges: DataFrame, n: int = 3) -> DataFrame:
    """``pattern`` (edges over 1..n) and ``count`` for all patterns, those that don't occur with 0.

    Candidate sets meet the edges inside them through their own subsets, so no set is compared with all edges.
    """
    if n not in (3, 4):
        raise InvalidParameterError("motifs have 3 or 4 nodes")
    sets = cut(_candidate_sets(edges, n))
    present = edges.where(F.col("size").between(2, n)).select("nodes", "size")
    found = None
    for bit, slot in enumerate(slots(n)):
        part = F.array(*[F.col("of")[x] for x in slot])
        want = sets.select(F.col("nodes").alias("of"), "way").select("of", part.alias("nodes"), F.lit(1 << bit).alias("bit"))
        found = want if found is None else found.unionByName(want)
    hits = found.join(present.select("nodes"), "nodes", "left_semi").groupBy("of").agg(F.sum("bit").alias("mask"))
    masks = hits.groupBy("mask").agg(F.count("*").alias("n"))  # at most 2 ** slots rows
    table = canonical_masks(n)
    counts = dict.fromkeys(sorted(set(table.values())), 0)
    for r in masks.collect():
        if r.mask in table:
            counts[table[r.mask]] += r.n
    return edges.sparkSession.createDataFrame([(pattern_text(m, n), c) for m, c in counts.items()], "pattern string, count bigint")


def motif_profile(edges: DataFrame, n: int = 3, *, runs: int = 10, seed: int = 0, steps: int | None = None) -> DataFrame:
    """``pattern``, ``count``, ``mean`` in ``runs`` randomized hypergraphs, ``z`` and the normalized ``profile``.

    delta = (count - mean) / (count + mean + 4), scaled to length 1; z = (count - mean) / (sd + 0.01). The
    null model swaps nodes between edges of one size, keeping degrees and sizes.
    """
    observed = {r.pattern: r["count"] for r in count_motifs(edges, n).collect()}  # a row per pattern

    def null_counts(k: int) -> dict[str, int]:
        null = cut(edge_swaps(edges, steps=steps, seed=seed * 1000 + k))
        return {r.pattern: r["count"] for r in count_motifs(null, n).collect()}

    with ThreadPoolExecutor(PARALLEL_RUNS) as pool:  # the runs don't depend on each other
        randomized = list(pool.map(null_counts, range(runs)))
    rows, length = [], 0.0
    for pattern, count in observed.items():
        null = np.array([r[pattern] for r in randomized], dtype=float) if randomized else np.zeros(1)
        delta = (count - null.mean()) / (count + null.mean() + 4)
        length += delta**2
        rows.append((pattern, count, float(null.mean()), float((count - null.mean()) / (null.std() + 0.01)), float(delta)))
    scale = length**0.5 or 1.0
    return edges.sparkSession.createDataFrame([(*r[:4], float(r[4] / scale)) for r in rows], "pattern string, count bigint, mean double, z double, profile double")


# -- directed


def canonical_directed(arcs: list[tuple[tuple[int, ...], tuple[int, ...]]], nodes: list) -> str:
    """The least text of a set of directed edges over all relabelings of the nodes to 1..n."""
    best = None
    for p in permutations(range(1, len(nodes) + 1)):
        to = dict(zip(nodes, p))
        text = " ".join(sorted(f"{''.join(map(str, sorted(to[x] for x in s)))}>{''.join(map(str, sorted(to[x] for x in t)))}" for s, t in arcs))
        if best is None or text < best:
            best = text
    return best or ""


def count_directed_motifs(edges: DataFrame, n: int = 3) -> DataFrame:
    """``pattern`` and ``count``: directed edges inside sets of ``n`` nodes that an edge spans, or (n = 4) an edge of 3 with one that adds a node."""
    if n not in (3, 4):
        raise InvalidParameterError("motifs have 3 or 4 nodes")
    used = cut(edges.where("size(src) > 0 AND size(tgt) > 0").where(F.size("nodes") <= n).select("edge_id", "src", "tgt", "nodes"))
    sets = used.where(F.size("nodes") == n).select("nodes")
    if n == 4:
        a = used.where(F.size("nodes") == 3).select(F.col("nodes").alias("x"), F.explode("nodes").alias("node"))
        b = used.where(F.size("nodes") < 4).select(F.col("nodes").alias("y"), F.explode("nodes").alias("node"))
        sets = sets.unionByName(a.join(b, "node").select(F.array_sort(F.array_union("x", "y")).alias("nodes")).where("size(nodes) = 4"))
    sets = cut(sets.distinct().withColumn("edge_id", F.xxhash64("nodes")).select("edge_id", "nodes"))
    parts = subsets_of_size(sets, 1)
    for k in range(2, n + 1):
        parts = parts.unionByName(subsets_of_size(sets, k))
    # an edge lies in a set if its nodes are one of the set's subsets
    inside = parts.withColumnRenamed("part", "nodes").join(used.select("nodes", "src", "tgt"), "nodes")
    arcs = inside.groupBy("edge_id").agg(F.array_sort(F.collect_set(F.struct("src", "tgt"))).alias("arcs"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for frame in frames:
            out = []
            for nodes, arcs in zip(frame["nodes"], frame["arcs"]):
                at = {x: k for k, x in enumerate(nodes)}
                local = tuple(sorted((tuple(at[x] for x in a["src"]), tuple(at[x] for x in a["tgt"])) for a in arcs))
                if local not in known:
                    known[local] = canonical_directed(list(local), list(range(len(nodes))))
                out.append(known[local])
            yield pd.DataFrame({"pattern": out})

    return sets.join(arcs, "edge_id").select("nodes", "arcs").mapInPandas(run, "pattern string").groupBy("pattern").agg(F.count("*").alias("count"))
