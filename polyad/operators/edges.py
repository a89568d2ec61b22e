"""The edge table: canonical keys, batch upsert, removal, filters, windows and conversions.

A hypergraph is a table of edges with one row per key, and, where nodes may be isolated, a table ``node``
(and ``meta``). Columns of an edge table: ``edge_id`` (BIGINT, the least sequence number of what made
the edge), ``nodes`` (sorted array), ``size``, ``weight`` (DOUBLE), and by kind ``src`` and ``tgt``
(directed), ``time`` (temporal), ``layer`` (multiplex); ``meta`` if there is metadata. The key is
``nodes``, (src, tgt), (time, nodes) or (layer, nodes).
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType

from polyad.errors import InvalidParameterError
from polyad.functions.columns import canonical
from polyad.runtime import cut

DUPLICATES = ("accumulate_weight", "ignore", "replace_weight", "error")
METADATA = ("merge", "replace", "ignore")
KEYS = {"undirected": ["nodes"], "directed": ["src", "tgt"], "temporal": ["time", "nodes"], "multiplex": ["layer", "nodes"]}


def kind_of(edges: DataFrame) -> str:
    """The kind of hypergraph that an edge table's columns tell."""
    for kind, column in (("directed", "src"), ("temporal", "time"), ("multiplex", "layer")):
        if column in edges.columns:
            return kind
    return "undirected"


def _is_merged(rows: DataFrame) -> bool:
    return isinstance(rows.schema["meta"].dataType.valueType, ArrayType)


def merged_meta(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, every name with its distinct values in ascending order: MAP<STRING, ARRAY<STRING>>.

    Equal values stay one; contradicting values stand side by side. Merging is done on distinct
    (name, value) pairs, so a key of very many rows is reduced before the shuffle. Metadata that has been
    merged before, with arrays for values, is merged further.
    """
    pairs = rows.select(*keys, F.explode("meta").alias("name", "value"))
    if _is_merged(rows):
        pairs = pairs.select(*keys, "name", F.explode("value").alias("value"))
    pairs = pairs.where(F.col("value").isNotNull()).distinct()
    named = pairs.groupBy(*keys, "name").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return named.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "values")))).alias("meta"))


def upsert(rows: DataFrame, *, kind: str = "undirected", duplicate: str = "accumulate_weight", metadata: str = "merge", weighted: bool = True) -> DataFrame:
    """The edge table of ``rows`` with a sequence number ``seq`` each, in which later rows meet earlier ones.

    A null weight is 1. Rows of one key become one edge: its weight is the sum (``accumulate_weight``),
    the first (``ignore``) or the last (``replace_weight``); ``error`` fails when run. Of metadata,
    ``merge`` keeps all values, ``replace`` the last row's, ``ignore`` the first row's. Unweighted edges
    may only have the weight 1 and can't accumulate or replace. Rows without nodes are left out.
    """
    if duplicate not in DUPLICATES or metadata not in METADATA or kind not in KEYS:
        raise InvalidParameterError(f"unknown policy or kind: {duplicate}, {metadata}, {kind}")
    if not weighted and duplicate in ("accumulate_weight", "replace_weight"):
        raise InvalidParameterError("unweighted edges can't accumulate or replace weights")
    keys = KEYS[kind]
    if kind == "directed":
        rows = rows.withColumn("src", canonical(F.col("src"))).withColumn("tgt", canonical(F.col("tgt"))).where("size(src) + size(tgt) > 0")
    else:
        rows = rows.withColumn("nodes", canonical(F.col("nodes"))).where("size(nodes) > 0")
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in rows.columns else F.lit(1.0)
    if not weighted:
        weight = F.when(weight == 1.0, weight).otherwise(F.raise_error(F.lit("an unweighted edge can only have the weight 1")))
    rows = rows.withColumn("weight", weight)
    total = {"accumulate_weight": F.sum("weight"), "ignore": F.min_by("weight", "seq"), "replace_weight": F.max_by("weight", "seq"), "error": F.first("weight")}[duplicate]
    edges = rows.groupBy(*keys).agg(F.min("seq").alias("edge_id"), total.alias("weight"), F.count("*").alias("n"))
    if duplicate == "error":
        edges = edges.withColumn("weight", F.when(F.col("n") == 1, F.col("weight")).otherwise(F.raise_error(F.lit("an edge is given twice"))))
    edges = edges.drop("n")
    if "meta" in rows.columns:
        if metadata == "merge":
            metas = merged_meta(rows, keys)
        else:
            pick = F.max_by if metadata == "replace" else F.min_by
            metas = rows.groupBy(*keys).agg(pick("meta", "seq").alias("meta"))
        edges = edges.join(metas, keys, "left")
    if kind == "directed":
        edges = edges.withColumn("nodes", F.array_sort(F.array_union("src", "tgt"))).withColumn("size", F.size("src") + F.size("tgt"))
    else:
        edges = edges.withColumn("size", F.size("nodes"))
    head = ["edge_id", *[k for k in keys if k != "nodes"], "nodes", "size", "weight"]
    return edges.select(*head, *(["meta"] if "meta" in rows.columns else []))


def add_edges(edges: DataFrame, rows: DataFrame, **policy: Any) -> DataFrame:
    """Edges with more rows (``seq`` above all that made ``edges``), by the policies of ``upsert``."""
    old = edges.withColumnRenamed("edge_id", "seq").drop("size")
    if "meta" in old.columns and "meta" in rows.columns and _is_merged(old) and not _is_merged(rows):
        rows = rows.withColumn("meta", F.transform_values("meta", lambda k, v: F.array(v)))
    return upsert(old.unionByName(rows, allowMissingColumns=True), kind=kind_of(edges), **policy)


def remove_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges whose key isn't in ``keys``."""
    return edges.join(keys, KEYS[kind_of(edges)], "left_anti")


def incidences(edges: DataFrame) -> DataFrame:
    """One row per edge and node, with the edge's size and weight; of directed edges with ``role`` (source or target)."""
    kept = [c for c in ("edge_id", "size", "weight", "time", "layer") if c in edges.columns]
    if kind_of(edges) != "directed":
        return edges.select(*kept, F.explode("nodes").alias("node"))
    sides = [edges.select(*kept, F.lit(role).alias("role"), F.explode(side).alias("node")) for role, side in (("source", "src"), ("target", "tgt"))]
    return sides[0].unionByName(sides[1])


def node_table(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All nodes: those of the edges and the declared ones."""
    found = edges.select(F.explode("nodes").alias("node"))
    return (found if nodes is None else found.unionByName(nodes.select("node"))).distinct()


def remove_nodes(edges: DataFrame, gone: DataFrame, *, keep_edges: bool = False, duplicate: str = "accumulate_weight", metadata: str = "merge") -> DataFrame:
    """Without the nodes of ``gone``: their edges go too, or shrink (``keep_edges``) and meet others by the policies.

    Edges that lose all nodes go; edges that become equal have their metadata merged by ``metadata``.
    """
    touched = incidences(edges).join(gone.select("node").distinct(), "node", "left_semi").select("edge_id").distinct()
    if not keep_edges:
        return edges.join(touched, "edge_id", "left_anti")
    kind = kind_of(edges)
    left = incidences(edges).join(gone.select("node").distinct(), "node", "left_anti")
    if kind == "directed":
        side = lambda role: F.collect_set(F.when(F.col("role") == role, F.col("node")))
        members = left.groupBy("edge_id").agg(side("source").alias("src"), side("target").alias("tgt"))
    else:
        members = left.groupBy("edge_id").agg(F.collect_set("node").alias("nodes"))
    rest = edges.drop("nodes", "src", "tgt", "size").join(members, "edge_id").withColumnRenamed("edge_id", "seq")
    return upsert(rest, kind=kind, duplicate=duplicate, metadata=metadata)


def by_size(edges: DataFrame, *, order: int | None = None, size: int | None = None, up_to: bool = False) -> DataFrame:
    """Edges of an order or of a size, or up to it."""
    if order is not None and size is not None:
        raise InvalidParameterError("give order or size, not both")
    if order is None and size is None:
        return edges
    wanted = size if size is not None else order + 1
    return edges.where(F.col("size") <= wanted if up_to else F.col("size") == wanted)


def by_sizes(edges: DataFrame, *, orders: list[int] | None = None, sizes: list[int] | None = None) -> DataFrame:
    """Edges of any of the given orders or sizes."""
    if (orders is None) == (sizes is None):
        raise InvalidParameterError("give orders or sizes, one of them")
    return edges.where(F.col("size").isin([o + 1 for o in orders] if orders is not None else sizes))


def in_window(edges: DataFrame, start: int, end: int) -> DataFrame:
    """Temporal edges with start <= time < end."""
    return edges.where((F.col("time") >= start) & (F.col("time") < end))


def in_layer(edges: DataFrame, layer: str) -> DataFrame:
    return edges.where(F.col("layer") == layer)


def incident_edges(edges: DataFrame, node: Any) -> DataFrame:
    """Edges that hold a node."""
    return edges.where(F.array_contains("nodes", node))


def neighbors(edges: DataFrame) -> DataFrame:
    """``node`` and ``neighbor`` for every two nodes of a common edge, each once, in both directions."""
    a = edges.select("edge_id", "nodes", F.explode("nodes").alias("node"))
    return a.select("node", F.explode("nodes").alias("neighbor")).where("node != neighbor").distinct()


def isolates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Declared nodes in no edge."""
    return nodes.select("node").distinct().join(edges.select(F.explode("nodes").alias("node")), "node", "left_anti")


def non_isolates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("node").distinct().join(edges.select(F.explode("nodes").alias("node")), "node", "left_semi")


def isolated_nodes(edges: DataFrame, nodes: DataFrame, *, order: int | None = None, size: int | None = None) -> DataFrame:
    """Nodes without neighbors; a node that is only in edges of one node counts."""
    return isolates(by_size(edges, order=order, size=size).where("size(nodes) > 1"), node_table(edges, nodes))


def edges_by_node(edges: DataFrame) -> DataFrame:
    """``node`` and ``edge_ids``, ascending. A hub's list grows with its degree; for counts use ``degrees``."""
    return incidences(edges).groupBy("node").agg(F.array_sort(F.collect_set("edge_id")).alias("edge_ids"))


def size_distribution(edges: DataFrame) -> DataFrame:
    """``size`` and ``n_edges``."""
    return edges.groupBy("size").agg(F.count("*").alias("n_edges"))


def summary(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: numbers of nodes and edges, sizes, weight, whether all edges have one size, and time range or layers."""
    more = []
    if "time" in edges.columns:
        more = [F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.countDistinct("time").alias("n_times")]
    if "layer" in edges.columns:
        more = [F.array_join(F.array_sort(F.collect_set("layer")), "|").alias("layers"), F.countDistinct("layer").alias("n_layers")]
    own = F.size("nodes") if "src" in edges.columns else F.col("size")  # a directed edge is uniform by its distinct nodes
    of_edges = edges.agg(
        F.count("*").alias("n_edges"), F.max("size").alias("max_size"), (F.max("size") - 1).alias("max_order"), F.sum("weight").alias("total_weight"), (F.min(own) == F.max(own)).alias("uniform"), *more
    )
    of_nodes = node_table(edges, nodes).agg(F.count("*").alias("n_nodes"))
    return of_edges.crossJoin(of_nodes)  # one row each


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges all of whose nodes are in ``nodes``."""
    outside = edges.select("edge_id", F.explode("nodes").alias("node")).join(nodes.select("node").distinct(), "node", "left_anti")
    return edges.join(outside.select("edge_id").distinct(), "edge_id", "left_anti")


def criterion(criteria: dict[str, Any], mode: str = "all") -> Column:
    """A condition on columns: a value (null-safe), a list of values, or a function from Column to Column."""
    if mode not in ("all", "any"):
        raise InvalidParameterError("the mode of criteria is all or any")
    tests = []
    for name, wanted in criteria.items():
        column = F.col(name)
        if callable(wanted):
            tests.append(F.coalesce(wanted(column), F.lit(False)))
        elif isinstance(wanted, (list, tuple, set)):
            some = [x for x in wanted if x is not None]
            tests.append(F.coalesce(column.isin(some), F.lit(False)) | (column.isNull() if None in wanted else F.lit(False)))
        else:
            tests.append(column.eqNullSafe(F.lit(wanted)))
    return reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), tests, F.lit(mode == "all") if not tests else tests[0])


def attribute(name: str, wanted: str, *, merged: bool = True) -> Any:
    """A criterion for ``meta``: whether ``name`` has the value ``wanted``, among others if values have been ``merged``."""
    return lambda meta: F.array_contains(F.element_at(meta, name), wanted) if merged else F.element_at(meta, name) == wanted


def filter_hypergraph(
    edges: DataFrame,
    nodes: DataFrame,
    *,
    node_criteria: dict[str, Any] | None = None,
    edge_criteria: dict[str, Any] | None = None,
    mode: str = "keep",
    keep_edges: bool = False,
    node_mode: str = "all",
    edge_mode: str = "all",
) -> tuple[DataFrame, DataFrame]:
    """Keep or remove what meets the criteria; first nodes, then the edges that are left.

    ``nodes`` has one row per node and its attributes as columns; edge criteria are on columns of an edge
    table, metadata included (``attribute`` makes a criterion on a name of it). A node without attributes has nulls.
    """
    if mode not in ("keep", "remove"):
        raise InvalidParameterError("mode is keep or remove")
    flip = (lambda c: c) if mode == "keep" else (lambda c: ~c)
    if node_criteria:
        known = node_table(edges, nodes).join(nodes, "node", "left")
        keep = flip(criterion(node_criteria, node_mode))
        edges = remove_nodes(edges, known.where(~keep).select("node"), keep_edges=keep_edges)
        nodes = known.where(keep)
    if edge_criteria:
        edges = edges.where(flip(criterion(edge_criteria, edge_mode)))
    return edges, nodes


def tumbling_windows(edges: DataFrame, width: int) -> DataFrame:
    """Temporal edges merged in windows of ``width`` from time 0: ``window``, ``nodes``, ``size``, ``weight``, merged ``meta`` if there is any.

    Empty windows have no rows here; ``window_counts`` has every window, ``window_nodes`` every window with every node.
    """
    if width < 1:
        raise InvalidParameterError("the width of windows must be at least 1")
    grouped = edges.groupBy(F.expr(f"time div {width}").alias("window"), "nodes").agg(F.min("edge_id").alias("edge_id"), F.sum("weight").alias("weight"))
    if "meta" in edges.columns:
        metas = merged_meta(edges.withColumn("window", F.expr(f"time div {width}")), ["window", "nodes"])
        grouped = grouped.join(metas, ["window", "nodes"], "left")
    return grouped.withColumn("size", F.size("nodes"))


def window_nodes(edges: DataFrame, width: int, nodes: DataFrame | None = None) -> DataFrame:
    """``window`` and ``node``: every node in every window from 0 to the last, empty ones included, as each window is a hypergraph of all nodes."""
    return window_counts(edges, width).select("window").crossJoin(node_table(edges, nodes))  # as asked for: a row for each


def window_counts(edges: DataFrame, width: int) -> DataFrame:
    """``window``, ``n_edges``, ``total_weight`` of every window from 0 to the last, empty ones included."""
    counts = tumbling_windows(edges, width).groupBy("window").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("total_weight"))
    last = edges.agg(F.max(F.expr(f"time div {width}")).alias("last")).where("last IS NOT NULL")
    every = last.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("window"))
    filled = every.join(counts, "window", "left")
    return filled.select("window", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("total_weight", F.lit(0.0)).alias("total_weight"))


def snapshot_nodes(edges: DataFrame, nodes: DataFrame | None = None, *, every: bool = False) -> DataFrame:
    """``time`` and ``node``: the nodes of each time's hypergraph, or (``every``) all nodes at all times that have an edge."""
    if every:
        return edges.select("time").distinct().crossJoin(node_table(edges, nodes))  # as asked for: a row for each
    return edges.select("time", F.explode("nodes").alias("node")).distinct()


def snapshots(edges: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Temporal edges, each time a hypergraph of its own, within [start, end)."""
    if start is not None:
        edges = edges.where(F.col("time") >= start)
    if end is not None:
        edges = edges.where(F.col("time") < end)
    return edges.select("time", "nodes", "size", "weight")


def to_undirected(edges: DataFrame, *, keep_meta: bool = True) -> DataFrame:
    """Any kind as an undirected hypergraph: time, layer or direction dropped, weights summed, metadata merged (or dropped)."""
    rows = edges.select("nodes", "weight", F.col("edge_id").alias("seq"), *(["meta"] if keep_meta and "meta" in edges.columns else []))
    return upsert(rows.where("size(nodes) > 0"))


def edge_overlap(edges: DataFrame) -> DataFrame:
    """``nodes`` and ``overlap``, the weight of the edge over all layers."""
    return edges.groupBy("nodes").agg(F.sum("weight").alias("overlap"))


def times_of(edges: DataFrame, nodes: list[Any]) -> DataFrame:
    """The times at which an edge is present, ascending."""
    return edges.where(F.col("nodes") == F.array_sort(F.array(*[F.lit(x) for x in nodes]))).select("time").distinct().orderBy("time")


def dense_ids(nodes: DataFrame) -> DataFrame:
    """``node`` and ``id`` 0, 1, ... in the order of the nodes as text (10 before 2).

    Numbered by range: every range counts its own nodes and starts after the ranges before it.
    """
    placed = nodes.select("node").distinct().withColumn("name", F.col("node").cast("string")).repartitionByRange(F.col("name"))
    placed = cut(placed.withColumn("part", F.spark_partition_id()))  # the ranges must be the same in both reads
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    return placed.join(starts, "part").select("node", (F.col("start") + rank - 1).alias("id"))


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with each node replaced by its ``id`` in ``mapping`` (``node``, ``id``), sources and targets too; a node without an id is an error when run."""
    name = F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.raise_error(F.lit("a node has no new label")))
    for column in (c for c in ("nodes", "src", "tgt") if c in edges.columns):
        members = edges.select("edge_id", F.explode(column).alias("node")).join(mapping, "node", "left").groupBy("edge_id").agg(F.array_sort(F.collect_list(name)).alias("labels"))
        kind = members.schema["labels"].dataType
        edges = edges.join(members, "edge_id", "left").withColumn(column, F.coalesce("labels", F.array().cast(kind))).drop("labels")
    return edges


def unlabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """The inverse of ``relabel`` by the same mapping."""
    return relabel(edges, mapping.select(F.col("id").alias("node"), F.col("node").alias("id")))


def size_bins(edges: DataFrame, bounds: list[int]) -> DataFrame:
    """``low``, ``high`` (null for the last) and ``n_edges`` of bins of sizes [low, high) that begin at the ``bounds``; empty bins count 0."""
    if not bounds or sorted(set(bounds)) != list(bounds):
        raise InvalidParameterError("bounds must rise")
    bins = edges.sparkSession.createDataFrame(list(zip(bounds, [*bounds[1:], None])), "low int, high int")
    placed = size_distribution(edges).join(F.broadcast(bins), (F.col("size") >= F.col("low")) & (F.col("high").isNull() | (F.col("size") < F.col("high"))))
    counted = placed.groupBy("low").agg(F.sum("n_edges").alias("n_edges"))
    return bins.join(counted, "low", "left").select("low", "high", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def invariant_violations(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``violation`` and ``n`` for every broken rule of an edge table; empty if it is sound."""
    keys = KEYS[kind_of(edges)]
    checks = [
        ("key is not unique", edges.groupBy(*keys).count().where("count > 1")),
        ("edge_id is not unique", edges.groupBy("edge_id").count().where("count > 1")),
        ("nodes are not canonical", edges.where(F.col("nodes") != canonical(F.col("nodes")))),
        ("size is wrong", edges.where(F.col("size") != (F.size("src") + F.size("tgt") if "src" in edges.columns else F.size("nodes")))),
        ("weight is null", edges.where("weight IS NULL")),
    ]
    if "time" in edges.columns:
        checks.append(("time is negative", edges.where("time < 0")))
    if nodes is not None:
        checks.append(("node is not declared", node_table(edges).join(nodes.select("node"), "node", "left_anti")))
    found = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n") for name, df in checks]
    return reduce(DataFrame.unionByName, found).where("n > 0")


def contains(edges: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs ``edge_id``, ``inner_id`` where an edge of ``others`` lies within an edge of ``edges``; met through common nodes."""
    outer = edges.select("edge_id", F.explode("nodes").alias("node"))
    inner = others.select(F.col("edge_id").alias("inner_id"), F.size("nodes").alias("inner_size"), F.explode("nodes").alias("node"))
    met = outer.join(inner, "node").groupBy("edge_id", "inner_id", "inner_size").agg(F.count("*").alias("n"))
    return met.where("n = inner_size").select("edge_id", "inner_id")
