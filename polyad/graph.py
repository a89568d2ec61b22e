"""Hypergraphs as objects: a thin, immutable layer over the operators on tables.

Every method returns a DataFrame, a number, or a new ``Hypergraph``; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError, MissingEdgeError, MissingNodeError
from polyad.operators import centrality, degree, dynamics, edges as E, fits, matrices, motifs, paths, projections, reducibility, validation
from polyad.runtime import cut
from polyad.sources.files import TYPES, Stored, content_hash, read_hypergraph, write_hypergraph


@dataclass(frozen=True)
class Hypergraph:
    """``edges`` and ``nodes`` (``node``, ``meta``) with the policies by which more edges are added.

    A directed edge is given as (sources, targets), a temporal one as (time, nodes), a multiplex one as
    (layer, nodes); sizes of directed edges are sources plus targets, order is size - 1.
    """

    edges: DataFrame
    nodes: DataFrame
    kind: str = "undirected"
    weighted: bool = True
    duplicate: str = "accumulate_weight"
    metadata: str = "merge"
    meta: dict | None = None
    incidence_meta: DataFrame | None = None
    empty_edges: DataFrame | None = None

    # -- construction

    @classmethod
    def from_rows(cls, rows: DataFrame, *, nodes: DataFrame | None = None, kind: str = "undirected", weighted: bool = True, duplicate: str | None = None, metadata: str = "merge") -> Hypergraph:
        """From a table with ``nodes`` (or ``src`` and ``tgt``) and maybe ``weight``, ``time``, ``layer``, ``meta`` and ``seq``."""
        duplicate = duplicate or ("accumulate_weight" if weighted else "ignore")
        if "seq" not in rows.columns:
            rows = cut(rows).withColumn("seq", F.monotonically_increasing_id())
        edges = E.upsert(rows, kind=kind, duplicate=duplicate, metadata=metadata, weighted=weighted)
        declared = nodes if nodes is not None else E.node_table(edges).limit(0)
        known = E.node_table(edges, declared)
        if "meta" in declared.columns:
            known = known.join(declared.select("node", "meta"), "node", "left")
        else:
            known = known.withColumn("meta", F.lit(None).cast("map<string,string>"))
        return cls(edges, known, kind, weighted, duplicate, metadata)

    @classmethod
    def from_edges(cls, spark: SparkSession, edge_list: Iterable[Any], *, weights: Iterable[float] | None = None, metas: Iterable[dict] | None = None, kind: str = "undirected", **options: Any) -> Hypergraph:
        """From a Python list of edges, in the form that the kind has."""
        edge_list = list(edge_list)
        weights = list(weights) if weights is not None else [None] * len(edge_list)
        metas = list(metas) if metas is not None else [None] * len(edge_list)
        if not len(edge_list) == len(weights) == len(metas):
            raise InvalidParameterError("edges, weights and metadata differ in number")
        rows, text = [], False
        for k, (e, w, m) in enumerate(zip(edge_list, weights, metas)):
            if kind == "undirected":
                head, parts = (), [list(e)]
            elif kind == "directed":
                head, parts = (), [list(e[0]), list(e[1])]
            else:
                head, parts = (e[0],), [list(e[1])]
                if kind == "temporal" and (isinstance(e[0], bool) or not isinstance(e[0], int) or e[0] < 0):
                    raise InvalidParameterError("a time is a whole number from 0 on")
            text = text or any(isinstance(x, str) for p in parts for x in p)
            rows.append((k, *head, *parts, None if w is None else float(w), None if m is None else {a: str(b) for a, b in m.items()}))
        node = "string" if text else "bigint"
        if text:
            rows = [tuple([str(x) for x in v] if isinstance(v, list) else v for v in r) for r in rows]
        head = {"temporal": "time bigint, ", "multiplex": "layer string, "}.get(kind, "")
        members = f"src array<{node}>, tgt array<{node}>" if kind == "directed" else f"nodes array<{node}>"
        frame = spark.createDataFrame(rows, f"seq bigint, {head}{members}, weight double, meta map<string,string>")
        if all(m is None for m in metas):
            frame = frame.drop("meta")
        return cls.from_rows(frame, kind=kind, **options)

    @classmethod
    def read(cls, spark: SparkSession, path: str, **options: Any) -> Hypergraph:
        s = read_hypergraph(spark, path, **options)
        return cls(s.edges, s.nodes, s.kind, s.weighted, meta=s.meta)

    def write(self, path: str, *, fmt: str = "parquet") -> None:
        write_hypergraph(self.stored(), path, fmt=fmt)

    def stored(self) -> Stored:
        return Stored(self.edges, self.nodes, self.kind, self.weighted, self.meta or {})

    def hash(self) -> str:
        return content_hash(self.stored())

    def cached(self) -> Hypergraph:
        """With edges and nodes written to the shared folder, for repeated use."""
        return replace(self, edges=cut(self.edges), nodes=cut(self.nodes))

    # -- change

    def _with(self, edges: DataFrame, nodes: DataFrame | None = None) -> Hypergraph:
        return replace(self, edges=edges, nodes=self.nodes if nodes is None else nodes)

    def with_policies(self, duplicate: str | None = None, metadata: str | None = None) -> Hypergraph:
        return replace(self, duplicate=duplicate or self.duplicate, metadata=metadata or self.metadata)

    def add_nodes(self, nodes: DataFrame) -> Hypergraph:
        """More nodes; metadata only fills what is empty."""
        more = nodes if "meta" in nodes.columns else nodes.withColumn("meta", F.lit(None).cast("map<string,string>"))
        more = more.groupBy("node").agg(F.first("meta", ignorenulls=True).alias("new"))
        joined = self.nodes.join(more, "node", "full")
        filled = F.when(F.col("meta").isNull() | (F.size("meta") == 0), F.coalesce("new", "meta")).otherwise(F.col("meta"))
        return self._with(self.edges, joined.select("node", filled.alias("meta")))

    def add_edges(self, rows: DataFrame) -> Hypergraph:
        """More edges, by the policies; new nodes come with them. ``rows`` as for ``from_rows``."""
        top = self.edges.agg(F.max("edge_id")).first()[0]
        rows = cut(rows).withColumn("seq", F.monotonically_increasing_id() + (0 if top is None else top + 1)) if "seq" not in rows.columns else rows
        edges = E.add_edges(self.edges, rows, duplicate=self.duplicate, metadata=self.metadata, weighted=self.weighted)
        return self._with(edges, E.node_table(edges, self.nodes).join(self.nodes, "node", "left"))

    def remove_edges(self, keys: DataFrame) -> Hypergraph:
        """Without edges; an edge that isn't there is an error."""
        if not keys.join(self.edges, E.KEYS[self.kind], "left_anti").isEmpty():
            raise MissingEdgeError("an edge to remove isn't there")
        return self._with(E.remove_edges(self.edges, keys))

    def remove_nodes(self, gone: DataFrame, *, keep_edges: bool = False) -> Hypergraph:
        """Without nodes, and without their edges or (``keep_edges``) with these made smaller; a node that isn't there is an error."""
        if not gone.join(self.nodes, "node", "left_anti").isEmpty():
            raise MissingNodeError("a node to remove isn't there")
        return self._with(E.remove_nodes(self.edges, gone, keep_edges=keep_edges, duplicate=self.duplicate, metadata=self.metadata), self.nodes.join(gone, "node", "left_anti"))

    def clear(self) -> Hypergraph:
        return self._with(self.edges.limit(0), self.nodes.limit(0))

    def set_weights(self, weights: DataFrame) -> Hypergraph:
        """New weights for the keys in ``weights`` (key columns and ``weight``)."""
        joined = self.edges.join(weights.withColumnRenamed("weight", "new_weight"), E.KEYS[self.kind], "left")
        return self._with(joined.withColumn("weight", F.coalesce(F.col("new_weight").cast("double"), "weight")).select(self.edges.columns))

    def set_node_meta(self, metas: DataFrame) -> Hypergraph:
        """New metadata for the nodes in ``metas`` (``node``, ``meta``)."""
        joined = self.nodes.join(metas.withColumnRenamed("meta", "new"), "node", "left")
        return self._with(self.edges, joined.select("node", F.coalesce("new", "meta").alias("meta")))

    def set_node_attribute(self, name: str, values: DataFrame) -> Hypergraph:
        """One attribute (``node``, ``value``) of the nodes."""
        joined = self.nodes.join(values, "node", "left")
        kept = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: k != name)
        return self._with(self.edges, joined.select("node", F.when(F.col("value").isNotNull(), F.map_concat(kept, F.create_map(F.lit(name), F.col("value").cast("string")))).otherwise(F.col("meta")).alias("meta")))

    def remove_node_attribute(self, name: str) -> Hypergraph:
        return self._with(self.edges, self.nodes.withColumn("meta", F.map_filter("meta", lambda k, v: k != name)))

    def set_edge_meta(self, metas: DataFrame) -> Hypergraph:
        """New metadata for the keys in ``metas`` (key columns and ``meta``, as the edges have it)."""
        joined = self.edges.drop("meta").join(metas.select(*E.KEYS[self.kind], F.col("meta").alias("new")), E.KEYS[self.kind], "left")
        old = self.edges.select("edge_id", "meta") if "meta" in self.edges.columns else None
        if old is None:
            return self._with(joined.withColumnRenamed("new", "meta"))
        return self._with(joined.join(old, "edge_id").withColumn("meta", F.coalesce("new", "meta")).drop("new"))

    def remove_edge_attribute(self, name: str) -> Hypergraph:
        return self._with(self.edges.withColumn("meta", F.map_filter("meta", lambda k, v: k != name)))

    def set_incidence_meta(self, metas: DataFrame) -> Hypergraph:
        """Metadata of nodes in edges: key columns, ``node`` and ``meta``; an incidence that isn't there is an error."""
        keys = [*E.KEYS[self.kind], "node"]
        held = self.edges.select(*E.KEYS[self.kind], F.explode("nodes").alias("node"))
        if not metas.join(held, keys, "left_anti").isEmpty():
            raise MissingEdgeError("a node isn't in the edge")
        new = metas.select(*keys, "meta")
        if self.incidence_meta is not None:
            new = new.unionByName(self.incidence_meta.join(new, keys, "left_anti"))
        return replace(self, incidence_meta=new)

    def set_meta(self, **values: Any) -> Hypergraph:
        """Metadata of the hypergraph itself."""
        return replace(self, meta={**(self.meta or {}), **values})

    def add_empty_edges(self, edges: DataFrame) -> Hypergraph:
        """Named edges without nodes (``name``, ``meta``), kept apart from the others; a name that is there is an error."""
        if self.empty_edges is not None:
            if not edges.join(self.empty_edges, "name", "left_semi").isEmpty():
                raise InvalidParameterError("an empty edge of this name is there already")
            edges = self.empty_edges.unionByName(edges)
        return replace(self, empty_edges=edges)

    # -- look

    def sources(self) -> DataFrame:
        """``src`` of every directed edge."""
        self._needs("directed")
        return self.edges.select("src")

    def targets(self) -> DataFrame:
        self._needs("directed")
        return self.edges.select("tgt")

    def source_edges(self, node: Any, **of: int) -> DataFrame:
        """Directed edges with the node among their sources."""
        self._needs("directed")
        return E.by_size(self.edges, **of).where(F.array_contains("src", node))

    def target_edges(self, node: Any, **of: int) -> DataFrame:
        self._needs("directed")
        return E.by_size(self.edges, **of).where(F.array_contains("tgt", node))

    def edges_by_size(self) -> DataFrame:
        """``size``, ``order`` and the edges' ids, ascending. A size's list grows with its edges; for numbers use ``sizes``."""
        return self.edges.groupBy("size").agg((F.first("size") - 1).alias("order"), F.array_sort(F.collect_list("edge_id")).alias("edge_ids"))

    def layers(self) -> DataFrame:
        self._needs("multiplex")
        return self.edges.select("layer").distinct()

    def times(self) -> DataFrame:
        self._needs("temporal")
        return self.edges.select("time").distinct()

    def get_edges(self, *, order: int | None = None, size: int | None = None, up_to: bool = False, time_window: tuple[int, int] | None = None, layer: str | None = None) -> DataFrame:
        found = E.by_size(self.edges, order=order, size=size, up_to=up_to)
        if time_window is not None:
            self._needs("temporal")
            found = E.in_window(found, *time_window)
        if layer is not None:
            self._needs("multiplex")
            found = E.in_layer(found, layer)
        return found

    def _needs(self, kind: str) -> None:
        if self.kind != kind:
            raise InvalidParameterError(f"this needs a {kind} hypergraph, not a {self.kind} one")

    def view(self) -> EdgeView:
        return EdgeView(self)

    def check_node(self, node: Any) -> bool:
        return not self.nodes.where(F.col("node") == node).isEmpty()

    def check_edge(self, nodes: Iterable[Any], **key: Any) -> bool:
        return not self._edge(nodes, key).isEmpty()

    def _edge(self, nodes: Iterable[Any], key: dict) -> DataFrame:
        found = self.edges.where(F.col("nodes") == F.array(*[F.lit(x) for x in sorted(set(nodes))]))
        for name, value in key.items():
            found = found.where(F.col(name) == value)
        return found

    def get_weight(self, nodes: Iterable[Any], **key: Any) -> float:
        row = self._edge(nodes, key).select("weight").first()
        if row is None:
            raise MissingEdgeError("there is no such edge")
        return row.weight

    def incident_edges(self, node: Any, **of: int) -> DataFrame:
        if not self.check_node(node):
            raise MissingNodeError(f"{node!r} isn't a node")
        return E.incident_edges(E.by_size(self.edges, **of), node)

    def neighbors(self, node: Any, **of: int) -> DataFrame:
        return self.incident_edges(node, **of).select(F.explode("nodes").alias("node")).where(F.col("node") != node).distinct()

    def num_nodes(self) -> int:
        return self.nodes.count()

    def num_edges(self, **of: Any) -> int:
        return E.by_size(self.edges, **of).count()

    def node_view(self) -> NodeView:
        return NodeView(self)

    def tables(self) -> dict[str, Any]:
        """All that the object holds, by name; ``from_tables`` takes it back."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @classmethod
    def from_tables(cls, tables: dict[str, Any]) -> Hypergraph:
        return cls(**tables)

    def relabeled(self) -> tuple[Hypergraph, DataFrame]:
        """With nodes 0, 1, ... in the order of their text, and the mapping (``node``, ``id``)."""
        mapping = cut(E.dense_ids(self.nodes))
        nodes = self.nodes.join(mapping, "node").select(F.col("id").alias("node"), "meta")
        return self._with(E.relabel(self.edges, mapping), nodes), mapping

    def sizes(self) -> DataFrame:
        return E.size_distribution(self.edges)

    def summary(self) -> DataFrame:
        return E.summary(self.edges, self.nodes)

    def is_uniform(self) -> bool:
        return bool(self.summary().first().uniform)

    def isolates(self) -> DataFrame:
        return E.isolates(self.edges, self.nodes)

    def isolated_nodes(self, **of: int) -> DataFrame:
        return E.isolated_nodes(self.edges, self.nodes, **of)

    def violations(self) -> DataFrame:
        return E.invariant_violations(self.edges, self.nodes)

    # -- derive

    def subhypergraph(self, nodes: DataFrame) -> Hypergraph:
        """Edges within ``nodes``; these stay even if isolated."""
        return self._with(E.induced(self.edges, nodes), self.nodes.join(nodes.select("node"), "node", "left_semi"))

    def subhypergraph_by(self, *, orders: list[int] | None = None, sizes: list[int] | None = None, keep_nodes: bool = True) -> Hypergraph:
        found = E.by_sizes(self.edges, orders=orders, sizes=sizes)
        return self._with(found, self.nodes if keep_nodes else self.nodes.join(E.node_table(found), "node", "left_semi"))

    def largest_component(self, **of: int) -> Hypergraph:
        return self.subhypergraph(paths.largest_component(self.components(**of)))

    def filter(self, **options: Any) -> Hypergraph:
        found, nodes = E.filter_hypergraph(self.edges, self.nodes, **options)
        return self._with(found, self.nodes.join(nodes.select("node"), "node", "left_semi"))

    def to_undirected(self, *, keep_node_meta: bool = True, keep_edge_meta: bool = True, keep_meta: bool = True) -> Hypergraph:
        """Time, layer or direction dropped; weights summed and metadata merged. Each kind of metadata may be left behind."""
        nodes = self.nodes if keep_node_meta else self.nodes.withColumn("meta", F.lit(None).cast(self.nodes.schema["meta"].dataType))
        meta = {**(self.meta or {}), "converted_from": TYPES[self.kind]} if keep_meta else None
        return Hypergraph(E.to_undirected(self.edges, keep_meta=keep_edge_meta), nodes, meta=meta)

    def windows(self, width: int) -> DataFrame:
        self._needs("temporal")
        return E.tumbling_windows(self.edges, width)

    # -- measure

    def degrees(self, **of: int) -> DataFrame:
        return degree.degrees(self.edges, self.nodes, **of)

    def degree_distribution(self, **of: int) -> DataFrame:
        return degree.degree_distribution(self.edges, self.nodes, **of)

    def in_degrees(self, **of: int) -> DataFrame:
        self._needs("directed")
        return degree.in_degrees(self.edges, self.nodes, **of)

    def out_degrees(self, **of: int) -> DataFrame:
        self._needs("directed")
        return degree.out_degrees(self.edges, self.nodes, **of)

    def components(self, **of: int) -> DataFrame:
        return paths.connected_components(self.edges, self.nodes, **of)

    def is_connected(self, **of: int) -> bool:
        return paths.is_connected(self.components(**of))

    def line_graph(self, **options: Any) -> DataFrame:
        return (projections.directed_line_graph if self.kind == "directed" else projections.line_graph)(self.edges, **options)

    def clique(self) -> DataFrame:
        return projections.clique(self.edges)

    def simplicial_complex(self) -> DataFrame:
        return projections.simplicial_complex(self.edges)

    def incidence(self, **options: Any) -> DataFrame:
        return matrices.incidence(self.edges, **options)

    def adjacency(self, **options: Any) -> DataFrame:
        return (matrices.temporal_adjacency if self.kind == "temporal" else matrices.adjacency)(self.edges, **options)

    def annealed_adjacency(self, **options: Any) -> DataFrame:
        self._needs("temporal")
        return matrices.annealed_adjacency(self.edges, **options)

    def adjacency_factor(self, t: float = 0, **options: Any) -> DataFrame:
        return matrices.adjacency_factor(matrices.annealed_adjacency(self.edges, **options) if self.kind == "temporal" else matrices.adjacency(self.edges, **options), t)

    def dual_adjacency(self) -> DataFrame:
        return matrices.dual_adjacency(self.edges)

    def laplacian(self, order: int, **options: Any) -> DataFrame:
        return matrices.laplacian(self.edges, order, **options)

    def multiorder_laplacian(self, sigmas: list[float], **options: Any) -> DataFrame:
        return matrices.multiorder_laplacian(self.edges, sigmas, self.num_nodes(), **options)

    def transition_matrix(self) -> DataFrame:
        return matrices.transition_matrix(self.edges)

    def stationary_state(self) -> DataFrame:
        if not self.is_connected():
            raise InvalidParameterError("the random walk needs a connected hypergraph")
        return dynamics.walk_stationary(self.edges)

    def centrality(self, which: str, **options: Any) -> DataFrame:
        found = {"clique": centrality.clique_centrality, "z": centrality.z_centrality, "h": centrality.h_centrality, "subhypergraph": centrality.subhypergraph_centrality}
        if which not in found:
            raise InvalidParameterError(f"unknown centrality: {which}")
        return found[which](self.edges, **options)

    def validated_edges(self, **options: Any) -> DataFrame:
        return validation.validated_edges(self.edges, **options)

    def validated_cores(self, **options: Any) -> DataFrame:
        return validation.validated_cores(self.edges, **options)

    def motifs(self, n: int = 3) -> DataFrame:
        return (motifs.count_directed_motifs if self.kind == "directed" else motifs.count_motifs)(self.edges, n)

    def core_periphery(self, **options: Any) -> fits.Scores:
        return fits.core_periphery(self.edges, **options)

    def edge_clusters(self, height: float, **options: Any) -> fits.EdgeClusters:
        return fits.edge_clusters(self.edges, height, **options)

    def spectral(self, k: int, **options: Any) -> fits.HardClusters:
        return fits.spectral(self.edges, k, nodes=self.nodes, **options)

    def size_model(self, k: int, **options: Any) -> fits.SoftClusters:
        return fits.size_model(self.edges, k, **options)

    def mixed_membership(self, k: int, **options: Any) -> fits.SoftClusters:
        return fits.mixed_membership(self.edges, k, **options)

    def reducibility(self, **options: Any) -> tuple[float, tuple[int, ...]]:
        return reducibility.reducibility(self.edges, self.nodes, **options)


@dataclass(frozen=True)
class NodeView:
    """The nodes, with filters on their metadata and degree that run when the frame is used."""

    graph: Hypergraph
    tests: tuple[Column, ...] = ()

    def attribute(self, name: str, value: str) -> NodeView:
        return replace(self, tests=(*self.tests, F.coalesce(F.element_at("meta", name) == value, F.lit(False))))

    def degree(self, least: int = 0, most: int | None = None) -> NodeView:
        test = F.col("degree") >= least if most is None else F.col("degree").between(least, most)
        return replace(self, tests=(*self.tests, test))

    def frame(self) -> DataFrame:
        """``node``, ``meta`` and ``degree``."""
        found = self.graph.nodes.join(self.graph.degrees(), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        for test in self.tests:
            found = found.where(test)
        return found

    def __contains__(self, node: Any) -> bool:
        return self.graph.check_node(node)


@dataclass(frozen=True)
class EdgeView:
    """Filters on edges that add up and run when the frame is used. A filter that contradicts another is an error."""

    graph: Hypergraph
    tests: tuple[tuple[str, Column], ...] = ()

    def _add(self, name: str, test: Column) -> EdgeView:
        if any(n == name for n, _ in self.tests):
            raise InvalidParameterError(f"there is a filter on {name} already")
        return replace(self, tests=(*self.tests, (name, test)))

    def order(self, order: int, up_to: bool = False) -> EdgeView:
        return self.size(order + 1, up_to)

    def size(self, size: int, up_to: bool = False) -> EdgeView:
        return self._add("size", F.col("size") <= size if up_to else F.col("size") == size)

    def time_window(self, window: tuple[int, int]) -> EdgeView:
        self.graph._needs("temporal")
        return self._add("time", (F.col("time") >= window[0]) & (F.col("time") < window[1]))

    def layer(self, layer: str) -> EdgeView:
        self.graph._needs("multiplex")
        return self._add("layer", F.col("layer") == layer)

    def frame(self) -> DataFrame:
        found = self.graph.edges
        for _, test in self.tests:
            found = found.where(test)
        return found
