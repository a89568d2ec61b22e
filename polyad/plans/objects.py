"""Queries of the graph object, and of operators on edges that take metadata, labels or several matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad import Hypergraph, errors
from polyad.functions.columns import common_nodes, jaccard, jaccard_distance, label
from polyad.operators import degree as D
from polyad.operators import edges as E
from polyad.operators import matrices as M
from polyad.operators import paths as P
from polyad.operators import projections as J
from polyad.plans import graphs as G
from polyad.plans.formats import graph_of
from polyad.plans.registry import Registry
from polyad.plans.structure import DECLARED_SQL, FLAT_SQL, PAIRED_SQL, SHOWN_SQL, STORED_SQL, _declared, _middle, _stored, rounded, shown
from polyad.plans.tables import table
from polyad.runtime import cut

REGISTRY = Registry()
query = REGISTRY.query
META = "map<string,string>"


def _meta(name: str, value: Column) -> Column:
    return F.create_map(F.lit(name), value.cast("string"))


# -- change


@query(f"WITH {G.RECORDS_SQL}, {DECLARED_SQL}, every AS (SELECT node FROM declared UNION SELECT node FROM i) SELECT node, node IN (SELECT node FROM declared) AS known FROM every")
def object_add_nodes(spark: SparkSession, folder: str) -> DataFrame:
    more = _declared(spark, folder).withColumn("meta", _meta("known", F.lit("yes")))
    found = graph_of(G.records(spark, folder)).add_nodes(more).nodes
    return found.select("node", F.coalesce(F.element_at("meta", "known") == "yes", F.lit(False)).alias("known"))


@query(f"WITH {G.PARTS_SQL}, old AS (SELECT nodes, weight FROM e WHERE size <= 3 UNION ALL SELECT nodes, 1.0 FROM e WHERE size BETWEEN 3 AND 4) SELECT array_to_string(nodes, '|') AS nodes, len(nodes) AS size, round(sum(weight), 6) AS weight FROM old GROUP BY old.nodes")
def object_add_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of up to 3 nodes, to which those of 3 and 4 are added: weights of what is there grow by 1."""
    edges = cut(G.parts(spark, folder))
    return shown(graph_of(edges.where("size <= 3")).add_edges(edges.where("size BETWEEN 3 AND 4").select("nodes")).edges)


@query(f"WITH {G.PARTS_SQL} SELECT {SHOWN_SQL} FROM e WHERE size <> 2")
def object_remove_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.parts(spark, folder))
    return shown(graph_of(edges).remove_edges(edges.where("size = 2").select("nodes")).edges)


@query(f"WITH {G.PARTS_SQL} SELECT array_to_string(nodes, '|') AS nodes, size, round(CASE WHEN size = 3 THEN weight * 2.5 ELSE weight END, 6) AS weight FROM e")
def object_set_weights(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.parts(spark, folder))
    return shown(graph_of(edges).set_weights(edges.where("size = 3").select("nodes", (F.col("weight") * 2.5).alias("weight"))).edges)


@query(f"WITH {G.RECORDS_SQL}, n AS (SELECT node, count(*) AS d FROM i GROUP BY node) SELECT node, CASE WHEN d > 50 THEN 'hub' END AS kind FROM n WHERE node % 7 <> 0 UNION ALL SELECT node, 'seventh' FROM n WHERE node % 7 = 0")
def object_node_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes set, set again and read."""
    graph = graph_of(cut(G.records(spark, folder)))
    hubs = graph.degrees().where("degree > 50").select("node", F.lit("hub").alias("value"))
    graph = graph.set_node_attribute("kind", hubs).set_node_attribute("gone", hubs).remove_node_attribute("gone")
    graph = graph.set_node_meta(graph.nodes.where("node % 7 = 0").select("node", _meta("kind", F.lit("seventh")).alias("meta")))
    return graph.nodes.select("node", F.element_at("meta", "kind").alias("kind"))


@query(f"WITH {G.PARTS_SQL} SELECT array_to_string(nodes, '|') AS nodes, CASE WHEN size = 4 THEN 'four' WHEN size = 5 THEN 'five' END AS name FROM e")
def object_edge_attributes(spark: SparkSession, folder: str) -> DataFrame:
    graph = graph_of(cut(G.parts(spark, folder)))
    for size, name in ((4, "four"), (5, "five")):
        graph = graph.set_edge_meta(graph.edges.where(F.col("size") == size).select("nodes", F.create_map(F.lit("name"), F.lit(name), F.lit("gone"), F.lit("x")).alias("meta")))
    return graph.remove_edge_attribute("gone").edges.select(label(F.col("nodes")).alias("nodes"), F.element_at("meta", "name").alias("name"))


@query(f"WITH {G.PARTS_SQL} SELECT node, count(*) AS n_marked FROM i WHERE size = 2 AND node % 2 = 0 GROUP BY node")
def object_incidence_meta(spark: SparkSession, folder: str) -> DataFrame:
    graph = graph_of(cut(G.parts(spark, folder)))
    even = graph.edges.where("size = 2").select("nodes", F.explode("nodes").alias("node")).where("node % 2 = 0")
    graph = graph.set_incidence_meta(even.withColumn("meta", _meta("even", F.lit("yes")))).set_incidence_meta(even.limit(5).withColumn("meta", _meta("even", F.lit("yes"))))
    return graph.incidence_meta.where(F.element_at("meta", "even") == "yes").groupBy("node").agg(F.count("*").alias("n_marked"))


@query(f"WITH {G.RECORDS_SQL} SELECT 'after clear' AS state, 0 AS n_edges, 0 AS n_nodes UNION ALL SELECT 'copy', (SELECT count(*) FROM e), (SELECT count(DISTINCT node) FROM i)")
def object_clear_and_copy(spark: SparkSession, folder: str) -> DataFrame:
    graph = graph_of(cut(G.records(spark, folder)))
    empty, copy = graph.clear(), Hypergraph.from_tables(graph.tables())
    return spark.createDataFrame([("after clear", empty.num_edges(), empty.num_nodes()), ("copy", copy.num_edges(), copy.num_nodes())], "state string, n_edges bigint, n_nodes bigint")


def _said(action: Callable[[], object]) -> str:
    try:
        action()
    except errors.PolyadError as e:
        return type(e).__name__
    except Exception:  # raised by the engine while rows are made
        return "runtime"
    return ""


@query(
    """SELECT * FROM (VALUES ('remove a missing node', 'MissingNodeError'), ('remove a missing edge', 'MissingEdgeError'), ('weight of a missing edge', 'MissingEdgeError'), ('incidents of a missing node', 'MissingNodeError'),
('order and size', 'InvalidParameterError'), ('time of another kind', 'InvalidParameterError'), ('unknown policy', 'InvalidParameterError'), ('unweighted sum', 'InvalidParameterError'), ('unknown format', 'InvalidFileTypeError'),
('edge given twice', 'runtime'), ('unweighted 2.0', 'runtime'), ('no new label', 'runtime')) x(action, error)"""
)
def error_taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    """What each wrong call raises, over the records."""
    graph = graph_of(cut(G.records(spark, folder)))
    node, edge = spark.createDataFrame([(-1,)], "node bigint"), spark.createDataFrame([([-1, -2],)], "nodes array<bigint>")
    rows = graph.edges.select(F.col("edge_id").alias("seq"), "nodes", F.lit(2.0).alias("weight"))
    cases = {
        "remove a missing node": lambda: graph.remove_nodes(node),
        "remove a missing edge": lambda: graph.remove_edges(edge),
        "weight of a missing edge": lambda: graph.get_weight([-1, -2]),
        "incidents of a missing node": lambda: graph.incident_edges(-1),
        "order and size": lambda: graph.get_edges(order=1, size=2),
        "time of another kind": lambda: graph.get_edges(time_window=(0, 1)),
        "unknown policy": lambda: E.upsert(rows, duplicate="sum"),
        "unweighted sum": lambda: E.upsert(rows, weighted=False),
        "unknown format": lambda: Hypergraph.read(spark, "x.pickle"),
        "edge given twice": lambda: E.upsert(rows.unionByName(rows), duplicate="error").collect(),
        "unweighted 2.0": lambda: E.upsert(rows, weighted=False, duplicate="ignore").collect(),
        "no new label": lambda: E.relabel(graph.edges, graph.nodes.select("node", F.col("node").alias("id")).limit(1)).collect(),
    }
    return spark.createDataFrame([(name, _said(action)) for name, action in cases.items()], "action string, error string")


@query(f"WITH {G.RECORDS_SQL} SELECT array_to_string(nodes, '|') AS nodes, size, 1.0::DOUBLE AS weight FROM e")
def edge_upsert_error(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without duplicates pass the policy that forbids them."""
    return shown(E.upsert(G.records(spark, folder).select(F.col("edge_id").alias("seq"), "nodes"), duplicate="error"))


# -- look


@query(f"WITH {G.FLOWS_SQL} SELECT side, node, count(*) AS n FROM (SELECT 'source' AS side, unnest(src) AS node FROM e UNION ALL SELECT 'target', unnest(tgt) FROM e) GROUP BY ALL")
def directed_sides(spark: SparkSession, folder: str) -> DataFrame:
    graph = graph_of(G.flows(spark, folder))
    parts = [df.select(F.lit(side).alias("side"), F.explode(column).alias("node")) for side, column, df in (("source", "src", graph.sources()), ("target", "tgt", graph.targets()))]
    return parts[0].unionByName(parts[1]).groupBy("side", "node").agg(F.count("*").alias("n"))


@query(
    f"""WITH {G.FLOWS_SQL}, shown AS (SELECT *, array_to_string(src, '|') AS s, array_to_string(tgt, '|') AS t FROM e)
SELECT 'source' AS side, s, t FROM shown WHERE list_contains(src, 3) AND size = 3 UNION ALL SELECT 'target', s, t FROM shown WHERE list_contains(tgt, 3) AND size = 2 UNION ALL SELECT 'incident', s, t FROM shown WHERE list_contains(nodes, 3) AND size = 4"""
)
def directed_incident(spark: SparkSession, folder: str) -> DataFrame:
    graph = graph_of(cut(G.flows(spark, folder)))
    parts = {"source": graph.source_edges(3, size=3), "target": graph.target_edges(3, size=2), "incident": graph.incident_edges(3, size=4)}
    out = None
    for side, df in parts.items():
        part = df.select(F.lit(side).alias("side"), label(F.col("src")).alias("s"), label(F.col("tgt")).alias("t"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {G.FLOWS_SQL}, near AS (SELECT DISTINCT unnest(nodes) AS node FROM e WHERE list_contains(nodes, 3)) SELECT node FROM near WHERE node <> 3")
def directed_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return graph_of(cut(G.flows(spark, folder))).neighbors(3)


@query(f"WITH {G.HOURS_SQL} SELECT time, {SHOWN_SQL} FROM e WHERE list_contains(nodes, (SELECT min(node) FROM i))")
def temporal_incident(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.hours(spark, folder))
    return shown(graph_of(edges).incident_edges(edges.agg(F.min(F.array_min("nodes"))).first()[0]), "time")


@query(f"WITH {G.HOURS_SQL}, first AS (SELECT min(node) AS n FROM i) SELECT DISTINCT b.node FROM i a JOIN i b ON a.edge_id = b.edge_id AND a.node <> b.node WHERE a.node = (SELECT n FROM first)")
def temporal_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.hours(spark, folder))
    return graph_of(edges).neighbors(edges.agg(F.min(F.array_min("nodes"))).first()[0])


@query(f"WITH {G.FLAGS_SQL} SELECT layer, {SHOWN_SQL} FROM e WHERE list_contains(nodes, 1)")
def multiplex_incident(spark: SparkSession, folder: str) -> DataFrame:
    return shown(graph_of(cut(G.flags(spark, folder))).incident_edges(1), "layer")


@query(f"WITH {G.FLAGS_SQL} SELECT layer, count(*) AS n_edges, count(DISTINCT size) = 1 AS uniform FROM e GROUP BY layer")
def multiplex_layers(spark: SparkSession, folder: str) -> DataFrame:
    graph = graph_of(cut(G.flags(spark, folder)))
    rows = [(r.layer, E.in_layer(graph.edges, r.layer).count(), graph_of(graph.get_edges(layer=r.layer)).is_uniform()) for r in graph.layers().collect()]  # a row per layer
    return spark.createDataFrame(rows, "layer string, n_edges bigint, uniform boolean")


@query(
    f"""WITH p AS (WITH {G.PARTS_SQL} SELECT min(size) AS a, max(size) AS b FROM e), f AS (WITH {G.FLOWS_SQL} SELECT min(len(nodes)) AS a, max(len(nodes)) AS b FROM e), h AS (WITH {G.HOURS_SQL} SELECT min(size) AS a, max(size) AS b FROM e)
SELECT 'parts' AS graph, a = b AS uniform FROM p UNION ALL SELECT 'pairs of parts', true UNION ALL SELECT 'flows', a = b FROM f UNION ALL SELECT 'hours', a = b FROM h"""
)
def uniform_checks(spark: SparkSession, folder: str) -> DataFrame:
    parts = cut(G.parts(spark, folder))
    graphs = {"parts": parts, "pairs of parts": parts.where("size = 2"), "flows": G.flows(spark, folder), "hours": G.hours(spark, folder)}
    return spark.createDataFrame([(name, graph_of(df).is_uniform()) for name, df in graphs.items()], "graph string, uniform boolean")


@query(f"WITH {G.FLAGS_SQL} SELECT layer, {SHOWN_SQL} FROM e WHERE size <= 3 AND layer = 'N'")
def edge_view(spark: SparkSession, folder: str) -> DataFrame:
    return shown(graph_of(G.flags(spark, folder)).view().order(2, up_to=True).layer("N").frame(), "layer")


@query(f"WITH {G.HOURS_SQL}, bounds AS (SELECT min(time) + (max(time) - min(time)) // 3 AS a, min(time) + 2 * ((max(time) - min(time)) // 3) AS b FROM e) SELECT time, {SHOWN_SQL} FROM e, bounds WHERE time >= a AND time < b AND size = 3")
def edge_view_times(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.hours(spark, folder))
    return shown(graph_of(edges).view().time_window(_middle(edges)).size(3).frame(), "time")


@query(f"WITH {G.RECORDS_SQL}, {DECLARED_SQL}, d AS (SELECT node, count(*) AS degree FROM i GROUP BY node) SELECT node, degree FROM d WHERE degree BETWEEN 5 AND 9 AND node IN (SELECT node FROM declared)")
def node_view(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _declared(spark, folder).withColumn("meta", _meta("declared", F.lit("yes")))
    return graph_of(cut(G.records(spark, folder)), nodes).node_view().degree(5, 9).attribute("declared", "yes").frame().select("node", "degree")


@query(f"WITH {G.HOURS_SQL} SELECT node, count(*) AS degree FROM i GROUP BY node")
def temporal_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph_of(G.hours(spark, folder)).degrees()


@query(f"WITH {G.FLAGS_SQL}, n AS (SELECT DISTINCT node FROM i), d AS (SELECT n.node, count(i.node) AS degree FROM n LEFT JOIN i ON i.node = n.node AND i.size = 4 GROUP BY 1) SELECT degree, count(*) AS n_nodes FROM d GROUP BY degree")
def multiplex_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph_of(G.flags(spark, folder)).degree_distribution(order=3)


@query(f"WITH {G.FLOWS_SQL}, n AS (SELECT DISTINCT unnest(nodes) AS node FROM e), s AS (SELECT unnest(src) AS node FROM e), t AS (SELECT unnest(tgt) AS node FROM e) SELECT node, (SELECT count(*) FROM s WHERE s.node = n.node) AS source_side, (SELECT count(*) FROM t WHERE t.node = n.node) AS target_side FROM n")
def side_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """In- and out-degree as the plain functions define them."""
    edges = cut(G.flows(spark, folder))
    return D.source_side_degrees(edges).withColumnRenamed("degree", "source_side").join(D.target_side_degrees(edges).withColumnRenamed("degree", "target_side"), "node")


@query(f"WITH {G.FLOWS_SQL}, every AS (SELECT x AS node FROM range(0, 40) r(x)) SELECT node FROM every WHERE node NOT IN (SELECT unnest(nodes) FROM e WHERE len(nodes) > 1)")
def isolated_directed(spark: SparkSession, folder: str) -> DataFrame:
    return graph_of(cut(G.flows(spark, folder)), spark.range(40).withColumnRenamed("id", "node")).isolated_nodes()


@query(f"WITH {G.HOURS_SQL}, m AS (SELECT max(node) AS top FROM i), every AS (SELECT x AS node FROM range(0, (SELECT top + 5 FROM m)) r(x)) SELECT node FROM every WHERE node NOT IN (SELECT node FROM i WHERE size > 1)")
def isolated_temporal(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.hours(spark, folder))
    top = edges.agg(F.max(F.array_max("nodes"))).first()[0]
    return graph_of(edges, spark.range(top + 5).withColumnRenamed("id", "node")).isolated_nodes()


LINKED_SQL = """links AS (SELECT DISTINCT a.node AS u, b.node AS v FROM i a JOIN i b ON a.edge_id = b.edge_id WHERE a.size = 2),
walk(node, seen) USING KEY (node) AS (
  SELECT u, u FROM links UNION SELECT l.v, min(w.seen) FROM walk w JOIN links l ON l.u = w.node JOIN recurring.walk r ON r.node = l.v WHERE w.seen < r.seen GROUP BY l.v),
comp AS (SELECT n.node, coalesce(w.seen, n.node) AS component FROM (SELECT DISTINCT node FROM i) n LEFT JOIN walk w ON w.node = n.node),
best AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)"""


@query(f"WITH RECURSIVE {G.PARTS_SQL}, {LINKED_SQL}, kept AS (SELECT node FROM comp WHERE component IN (SELECT component FROM best)) SELECT {SHOWN_SQL} FROM e WHERE edge_id NOT IN (SELECT edge_id FROM i WHERE node NOT IN (SELECT node FROM kept))")
def largest_component(spark: SparkSession, folder: str) -> DataFrame:
    """The part of the hypergraph on its largest component by pairs."""
    return shown(graph_of(cut(G.parts(spark, folder))).largest_component(size=2).edges)


@query(f"WITH RECURSIVE {G.PARTS_SQL}, {LINKED_SQL} SELECT count(DISTINCT component) AS n_components, count(DISTINCT component) = 1 AS connected, (SELECT count(*) FROM comp WHERE component = (SELECT component FROM comp WHERE node = 1)) AS n_with_first FROM comp")
def connectivity(spark: SparkSession, folder: str) -> DataFrame:
    """Number of components by pairs, whether they are one, and the size of a node's own."""
    graph = graph_of(cut(G.parts(spark, folder)))
    parts = cut(graph.components(size=2))
    own = parts.join(parts.where("node = 1").select("component"), "component", "left_semi").count()
    return spark.createDataFrame([(parts.select("component").distinct().count(), P.is_connected(parts), own)], "n_components bigint, connected boolean, n_with_first bigint")


@query(f"WITH {G.PARTS_SQL} SELECT a.x AS low, b.x AS high, count(e.edge_id) AS n_edges FROM (VALUES (1, 1), (2, 2), (3, 4), (4, 6), (5, 50)) a(k, x) LEFT JOIN (VALUES (1, 2), (2, 4), (3, 6), (4, 50)) b(k, x) USING (k) LEFT JOIN e ON e.size >= a.x AND (b.x IS NULL OR e.size < b.x) GROUP BY ALL")
def size_bins(spark: SparkSession, folder: str) -> DataFrame:
    return E.size_bins(G.parts(spark, folder), [1, 2, 4, 6, 50])


# -- metadata in what is derived

NAMED_SQL = "named AS (SELECT {keys}, name, list_sort(list_distinct(list(value))) AS found FROM pairs WHERE value IS NOT NULL GROUP BY ALL)"
SPREAD_SQL = "pairs AS (SELECT {keys}, x.key AS name, x.value AS value FROM (SELECT {source}, unnest(map_entries(meta)) AS x FROM stored))"


def _flat(edges: DataFrame, *keys: str) -> DataFrame:
    rows = edges.where("meta IS NOT NULL").select(*keys, label(F.col("nodes")).alias("nodes"), F.explode("meta").alias("name", "values"))
    return rows.select(*keys, "nodes", "name", F.array_join("values", ",").alias("found"))


@query(
    f"WITH {STORED_SQL.replace('layer, time_tick', 'layer, time_tick').replace(' WHERE len', ' WHERE layer IS NOT NULL AND len')}, {SPREAD_SQL.format(keys='nodes', source='nodes')}, {NAMED_SQL.format(keys='nodes')} SELECT array_to_string(nodes, '|') AS nodes, name, array_to_string(found, ',') AS found FROM named"
)
def conversion_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Layers dropped; the metadata of an edge in all its layers is merged."""
    edges = E.upsert(_stored(spark, folder).where("layer IS NOT NULL"), kind="multiplex")
    return _flat(E.to_undirected(edges))


@query(
    f"WITH {STORED_SQL.replace(' WHERE len', ' WHERE time_tick IS NOT NULL AND len')}, {SPREAD_SQL.format(keys='w, nodes', source='time // 100 AS w, nodes')}, {NAMED_SQL.format(keys='w, nodes')} SELECT w AS \"window\", array_to_string(nodes, '|') AS nodes, name, array_to_string(found, ',') AS found FROM named"
)
def window_meta(spark: SparkSession, folder: str) -> DataFrame:
    edges = E.upsert(_stored(spark, folder).where("time IS NOT NULL"), kind="temporal")
    return _flat(E.tumbling_windows(edges, 100), "window")


@query(
    f"WITH {STORED_SQL}, hubs AS (SELECT node FROM (SELECT DISTINCT nodes, unnest(nodes) AS node FROM stored) GROUP BY node HAVING count(*) > 100), kept AS (SELECT seq, list_sort(list(node)) AS nodes FROM (SELECT seq, unnest(nodes) AS node FROM stored) WHERE node NOT IN (SELECT node FROM hubs) GROUP BY seq), left_over AS (SELECT kept.nodes, meta FROM kept JOIN stored USING (seq)), "
    + SPREAD_SQL.format(keys="nodes", source="nodes").replace("FROM stored", "FROM left_over")
    + f", {NAMED_SQL.format(keys='nodes')} SELECT array_to_string(nodes, '|') AS nodes, name, array_to_string(found, ',') AS found FROM named"
)
def shrunk_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that lose their hubs and meet others: the metadata of all are merged."""
    edges = cut(E.upsert(_stored(spark, folder)))
    return _flat(E.remove_nodes(edges, D.degrees(edges).where("degree > 100").select("node"), keep_edges=True))


@query(f"WITH {G.HOURS_SQL}, w AS (SELECT min(time) AS low, max(time) AS high FROM e) SELECT 'windows' AS part, (high // 24 + 1) * (SELECT count(DISTINCT node) FROM i) AS n FROM w UNION ALL SELECT 'times', (SELECT count(DISTINCT (time, node)) FROM i) FROM w UNION ALL SELECT 'every', (SELECT count(DISTINCT time) FROM e) * (SELECT count(DISTINCT node) FROM i) FROM w")
def window_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of windows and of times, with and without those that are absent."""
    edges = cut(G.hours(spark, folder))
    parts = {"windows": E.window_nodes(edges, 24), "times": E.snapshot_nodes(edges), "every": E.snapshot_nodes(edges, every=True)}
    out = None
    for name, df in parts.items():
        part = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {G.FLAGS_SQL} {FLAT_SQL}")
def object_to_undirected(spark: SparkSession, folder: str) -> DataFrame:
    return shown(graph_of(G.flags(spark, folder)).to_undirected().edges)


# -- labels


@query(f"WITH {G.RECORDS_SQL}, d AS (SELECT node, row_number() OVER (ORDER BY node::VARCHAR) - 1 AS id FROM (SELECT DISTINCT node FROM i)) SELECT array_to_string(list_sort(list(d.id)), '|') AS nodes, any_value(e.weight) AS weight FROM e JOIN i USING (edge_id) JOIN d ON d.node = i.node GROUP BY e.edge_id")
def relabeled(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = graph_of(cut(G.records(spark, folder))).relabeled()
    return found.edges.select(label(F.col("nodes")).alias("nodes"), "weight")


@query(f"WITH {G.FLOWS_SQL} SELECT array_to_string(list_sort(list_transform(src, lambda x: 100 - x)), '|') AS src, array_to_string(list_sort(list_transform(tgt, lambda x: 100 - x)), '|') AS tgt, true AS back FROM e")
def relabeled_directed(spark: SparkSession, folder: str) -> DataFrame:
    """Sources and targets with new labels, and whether the inverse gives the old ones."""
    edges = cut(G.flows(spark, folder))
    mapping = E.node_table(edges).select("node", (100 - F.col("node")).alias("id"))
    new = E.relabel(edges, mapping)
    old = E.unlabel(new, mapping).select("edge_id", F.col("src").alias("s"), F.col("tgt").alias("t"))
    met = new.join(old, "edge_id").join(edges.select("edge_id", F.col("src").alias("s0"), F.col("tgt").alias("t0")), "edge_id")
    return met.select(label(F.col("src")).alias("src"), label(F.col("tgt")).alias("tgt"), ((F.col("s") == F.col("s0")) & (F.col("t") == F.col("t0"))).alias("back"))


# -- similarity and line graphs

MET3_SQL = "met AS (SELECT a.edge_id AS a, b.edge_id AS b, count(*) AS c, any_value(a.size) AS na, any_value(b.size) AS nb FROM i a JOIN i b ON a.node = b.node AND a.edge_id < b.edge_id GROUP BY ALL HAVING count(*) >= 3)"


@query(f"WITH {G.PARTS_SQL}, {MET3_SQL} SELECT a AS edge_a, b AS edge_b, c AS common, round(c / (na + nb - c), 6) AS jaccard, round(1 - c / (na + nb - c), 6) AS distance FROM met")
def edge_similarity(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.parts(spark, folder))
    pairs = J.line_graph(edges, s=3).select("edge_a", "edge_b")
    for x in "ab":
        pairs = pairs.join(edges.select(F.col("edge_id").alias(f"edge_{x}"), F.col("nodes").alias(f"nodes_{x}")), f"edge_{x}")
    a, b = F.col("nodes_a"), F.col("nodes_b")
    return rounded(pairs.select("edge_a", "edge_b", common_nodes(a, b).alias("common"), jaccard(a, b).alias("jaccard"), jaccard_distance(a, b).alias("distance")), "jaccard", "distance")


@query(f"WITH {G.PARTS_SQL}, met AS (SELECT a.edge_id AS a, b.edge_id AS b, count(*) AS c FROM i a JOIN i b ON a.node = b.node AND a.edge_id < b.edge_id GROUP BY ALL) SELECT a AS edge_a, count(*) AS n_links, sum(c)::DOUBLE AS total FROM met GROUP BY a")
def object_line_graph(spark: SparkSession, folder: str) -> DataFrame:
    return graph_of(G.parts(spark, folder)).line_graph().groupBy("edge_a").agg(F.count("*").alias("n_links"), F.sum("w").alias("total"))


@query(f"WITH {G.FLOWS_SQL}, a AS (SELECT edge_id, len(tgt) AS n, unnest(tgt) AS node FROM e WHERE size <= 4), b AS (SELECT edge_id, len(src) AS n, unnest(src) AS node FROM e WHERE size <= 4), met AS (SELECT a.edge_id AS x, b.edge_id AS y, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS w FROM a JOIN b ON a.node = b.node AND a.edge_id <> b.edge_id GROUP BY ALL) SELECT x AS edge_a, count(*) AS n_links, round(sum(w), 6) AS total FROM met WHERE w >= 0.5 GROUP BY x")
def object_directed_line_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Jaccard weights of at least one half between directed edges of up to 4 places, as a filtered view of the graph."""
    graph = graph_of(cut(G.flows(spark, folder).where("size <= 4")))
    found = graph.line_graph(distance="jaccard", s=0.5).groupBy("edge_a").agg(F.count("*").alias("n_links"), F.sum("w").alias("total"))
    return rounded(found, "total")


# -- matrices


@query(
    f"""WITH {G.SUPPLIERS_SQL}, {PAIRED_SQL}, a AS (SELECT row, col, count(*) AS v FROM paired WHERE size = 2 GROUP BY ALL), b AS (SELECT row, col, count(*) AS v FROM paired WHERE size = 3 GROUP BY ALL), one AS (SELECT DISTINCT node AS row, node AS col, 1 AS v FROM i),
ab AS (SELECT a.row, b.col, sum(a.v * b.v) AS v FROM a JOIN b ON a.col = b.row GROUP BY ALL UNION ALL SELECT b.row, a.col, -sum(a.v * b.v) FROM b JOIN a ON b.col = a.row GROUP BY ALL), gap AS (SELECT row, col, sum(v) AS v FROM ab GROUP BY ALL)
SELECT 'orders 1 and 2' AS pair, NOT EXISTS (SELECT 1 FROM gap WHERE v <> 0) AS commute UNION ALL SELECT 'order 1 and itself', true UNION ALL SELECT 'order 1 and one', true"""
)
def commuting(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.suppliers(spark, folder))
    a, b = (cut(M.adjacency(edges, order=k)) for k in (1, 2))
    one = E.node_table(edges).select(F.col("node").alias("row"), F.col("node").alias("col"), F.lit(1).cast("bigint").alias("val"))
    pairs = {"orders 1 and 2": [a, b], "order 1 and itself": [a, a], "order 1 and one": [a, one]}
    return spark.createDataFrame([(name, M.are_commuting(two)) for name, two in pairs.items()], "pair string, commute boolean")


@query(f"WITH {G.SUPPLIERS_SQL} SELECT node, count(*) * 2 AS n_entries FROM i WHERE size = 3 GROUP BY node")
def adjacency_tensor(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the tensor of triples by their first node."""
    found = M.adjacency_tensor(E.by_size(G.suppliers(spark, folder), size=3), 3)
    return found.groupBy(F.col("at")[0].alias("node")).agg(F.sum("val").alias("n_entries"))


@query(f"WITH {G.PARTS_SQL} SELECT node, edge_id, 1 AS val FROM i WHERE size = 3")
def binary_incidence(spark: SparkSession, folder: str) -> DataFrame:
    return M.binary_incidence(G.parts(spark, folder), order=2)


@query(f"WITH {G.SUPPLIERS_SQL}, {PAIRED_SQL}, m AS (SELECT row, col, count(*)::DOUBLE AS v FROM paired WHERE size = 2 GROUP BY ALL) SELECT row, col, round(v / sum(v) OVER (PARTITION BY row), 9) AS val FROM m")
def normalized_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.normalized_rows(M.adjacency(G.suppliers(spark, folder), order=1)), "val", digits=9)


@query(f"WITH {G.SUPPLIERS_SQL} SELECT node AS row, node AS col, count(*)::DOUBLE AS val FROM i WHERE size = 4 GROUP BY node")
def degree_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return M.degree_matrix(G.suppliers(spark, folder), 3)


@query(f"WITH {G.HOURS_SQL} SELECT a.time, a.node AS row, b.node AS col, count(*) AS val FROM i a JOIN i b ON a.edge_id = b.edge_id AND a.node <> b.node GROUP BY ALL")
def object_temporal_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return graph_of(G.hours(spark, folder)).adjacency()


@query(f"WITH {G.SUPPLIERS_SQL}, {PAIRED_SQL}, m AS (SELECT row, count(*) AS v FROM paired GROUP BY row, col), l AS (SELECT DISTINCT a.edge_id AS x, b.edge_id AS y FROM i a JOIN i b ON a.node = b.node WHERE a.size = 2 AND b.size = 2) SELECT 'factor' AS part, row AS name, round(sum(v ** 1.0), 3) AS val FROM m GROUP BY row UNION ALL SELECT 'dual', x, count(*) FROM l GROUP BY x")
def object_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """The adjacency factor and the dual random walk's matrix (of pairs) from the object."""
    graph = graph_of(cut(G.suppliers(spark, folder)))
    factor = rounded(graph.adjacency_factor(1.0), "factor", digits=3).select(F.lit("factor").alias("part"), F.col("node").alias("name"), F.col("factor").alias("val"))
    dual = graph._with(graph.get_edges(size=2)).dual_adjacency().groupBy("row").agg(F.sum("val").cast("double").alias("val"))
    return factor.unionByName(dual.select(F.lit("dual").alias("part"), F.col("row").alias("name"), "val"))
