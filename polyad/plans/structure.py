"""Queries of construction, filters, degrees, projections and matrices, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.functions.columns import canonical, label
from polyad.operators import degree as D
from polyad.operators import edges as E
from polyad.operators import matrices as M
from polyad.operators import projections as P
from polyad.plans import graphs as G
from polyad.plans.registry import Registry
from polyad.plans.tables import table
from polyad.runtime import cut

REGISTRY = Registry()
query = REGISTRY.query

#: What edges look like in results.
SHOWN_SQL = "array_to_string(nodes, '|') AS nodes, size, round(weight, 6) AS weight"


def shown(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select(*more, label(F.col("nodes")).alias("nodes"), "size", F.round("weight", 6).alias("weight"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded columns, without negative zeros."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


# -- construction

STORED_SQL = """stored AS (
  SELECT row_number() OVER (ORDER BY arrived_at, edge_id, recorded_at, weight) AS seq, coalesce(weight, 1.0) AS weight, lower(layer) AS layer, time_tick AS time, meta,
    list_sort(list_distinct(list_filter(interaction, lambda x: x IS NOT NULL))) AS nodes FROM hg_edges WHERE len(list_filter(interaction, lambda x: x IS NOT NULL)) > 0)"""


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hg_edges").select("edge_id", "weight", F.lower("layer").alias("layer"), F.col("time_tick").alias("time"), F.col("interaction").alias("nodes"), "meta")
    return rows.withColumn("seq", F.monotonically_increasing_id())


@query(f"WITH {STORED_SQL} SELECT array_to_string(nodes, '|') AS nodes, len(nodes) AS size, round(sum(weight), 6) AS weight FROM stored GROUP BY nodes")
def edge_upsert_accumulate(spark: SparkSession, folder: str) -> DataFrame:
    return shown(E.upsert(_stored(spark, folder).drop("meta")))


@query(f"WITH {G.RECORDS_SQL} SELECT array_to_string(nodes, '|') AS nodes, min(seq) AS first FROM records GROUP BY nodes")
def edge_upsert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.member_records(table(spark, folder, "hg_edges")).select(F.col("record").alias("seq"), F.col("members").alias("nodes"), F.col("record").cast("double").alias("weight"))
    return E.upsert(rows, duplicate="ignore").select(label(F.col("nodes")).alias("nodes"), F.col("weight").cast("bigint").alias("first"))


@query(f"WITH {G.RECORDS_SQL} SELECT array_to_string(nodes, '|') AS nodes, max(seq) AS last FROM records GROUP BY nodes")
def edge_upsert_replace(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.member_records(table(spark, folder, "hg_edges")).select(F.col("record").alias("seq"), F.col("members").alias("nodes"), F.col("record").cast("double").alias("weight"))
    return E.upsert(rows, duplicate="replace_weight").select(label(F.col("nodes")).alias("nodes"), F.col("weight").cast("bigint").alias("last"))


@query(
    f"""WITH {STORED_SQL}, pairs AS (SELECT nodes, unnest(map_entries(meta)) AS x FROM stored),
named AS (SELECT nodes, x.key AS name, list_sort(list_distinct(list(x.value))) AS found FROM pairs WHERE x.value IS NOT NULL GROUP BY ALL)
SELECT array_to_string(nodes, '|') AS nodes, name, array_to_string(found, ',') AS found FROM named"""
)
def metadata_merge(spark: SparkSession, folder: str) -> DataFrame:
    merged = E.upsert(_stored(spark, folder)).where("meta IS NOT NULL")
    return merged.select(label(F.col("nodes")).alias("nodes"), F.explode("meta").alias("name", "values")).select("nodes", "name", F.array_join("values", ",").alias("found"))


@query(
    """WITH pairs AS (SELECT idx AS node, unnest(map_entries(meta)) AS x FROM hg_node_records WHERE idx IS NOT NULL)
SELECT node, x.key AS name, array_to_string(list_sort(list_distinct(list(x.value))), ',') AS found FROM pairs WHERE x.value IS NOT NULL GROUP BY ALL"""
)
def node_metadata_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hg_node_records").where("idx IS NOT NULL").select(F.col("idx").alias("node"), "meta")
    return E.merged_meta(rows, ["node"]).select("node", F.explode("meta").alias("name", "values")).select("node", "name", F.array_join("values", ",").alias("found"))


HUBS_SQL = "SELECT node FROM (SELECT unnest(nodes) AS node FROM e) GROUP BY node HAVING count(*) > 30"


@query(f"WITH {G.PARTS_SQL}, gone AS ({HUBS_SQL}) SELECT {SHOWN_SQL} FROM e WHERE edge_id NOT IN (SELECT edge_id FROM i WHERE node IN (SELECT node FROM gone))")
def remove_nodes(spark: SparkSession, folder: str) -> DataFrame:
    edges = G.parts(spark, folder)
    return shown(E.remove_nodes(edges, D.degrees(edges).where("degree > 30").select("node")))


@query(
    f"""WITH {G.PARTS_SQL}, gone AS ({HUBS_SQL}),
kept AS (SELECT edge_id, weight AS w, list_sort(list(node)) AS nodes FROM i WHERE node NOT IN (SELECT node FROM gone) GROUP BY ALL)
SELECT array_to_string(nodes, '|') AS nodes, len(nodes) AS size, round(sum(w), 6) AS weight FROM kept GROUP BY kept.nodes"""
)
def remove_node_keep_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = G.parts(spark, folder)
    return shown(E.remove_nodes(edges, D.degrees(edges).where("degree > 30").select("node"), keep_edges=True))


@query(f"WITH {G.FLOWS_SQL}, gone AS (SELECT unnest(nodes) AS n FROM e GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 0) SELECT array_to_string(src, '|') AS src, array_to_string(tgt, '|') AS tgt, size, weight FROM e")
def directed_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.flows(spark, folder).select(label(F.col("src")).alias("src"), label(F.col("tgt")).alias("tgt"), "size", "weight")


# -- scans and filters


@query(f"WITH {G.PARTS_SQL} SELECT size, count(*) AS n_edges FROM e GROUP BY size")
def edge_size_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return E.size_distribution(G.parts(spark, folder))


@query(f"WITH {G.RECORDS_SQL} SELECT count(*) AS n_edges, max(size) AS max_size, max(size) - 1 AS max_order, sum(weight) AS total_weight, min(size) = max(size) AS uniform, (SELECT count(DISTINCT node) FROM i) AS n_nodes FROM e")
def summary(spark: SparkSession, folder: str) -> DataFrame:
    return E.summary(G.records(spark, folder))


@query(
    f"""WITH {G.HOURS_SQL} SELECT count(*) AS n_edges, max(size) AS max_size, max(size) - 1 AS max_order, sum(weight) AS total_weight, min(size) = max(size) AS uniform,
min(time) AS first_time, max(time) AS last_time, count(DISTINCT time) AS n_times, (SELECT count(DISTINCT node) FROM i) AS n_nodes FROM e"""
)
def summary_temporal(spark: SparkSession, folder: str) -> DataFrame:
    return E.summary(G.hours(spark, folder))


@query(
    f"""WITH {G.FLAGS_SQL} SELECT count(*) AS n_edges, max(size) AS max_size, max(size) - 1 AS max_order, sum(weight) AS total_weight, min(size) = max(size) AS uniform,
(SELECT string_agg(DISTINCT layer, '|' ORDER BY layer) FROM e) AS layers, count(DISTINCT layer) AS n_layers, (SELECT count(DISTINCT node) FROM i) AS n_nodes FROM e"""
)
def summary_multiplex(spark: SparkSession, folder: str) -> DataFrame:
    return E.summary(G.flags(spark, folder))


@query(f"WITH {G.PARTS_SQL} SELECT {SHOWN_SQL} FROM e WHERE size <= 3")
def edges_by_size_upto(spark: SparkSession, folder: str) -> DataFrame:
    return shown(E.by_size(G.parts(spark, folder), size=3, up_to=True))


@query(f"WITH {G.PARTS_SQL} SELECT {SHOWN_SQL} FROM e WHERE size IN (3, 5)")
def subhypergraph_orders(spark: SparkSession, folder: str) -> DataFrame:
    return shown(E.by_sizes(G.parts(spark, folder), orders=[2, 4]))


MIDDLE_SQL = "bounds AS (SELECT min(time) + (max(time) - min(time)) // 3 AS a, min(time) + 2 * ((max(time) - min(time)) // 3) AS b FROM e)"


def _middle(edges: DataFrame) -> tuple[int, int]:
    low, high = edges.agg(F.min("time"), F.max("time")).first()
    return low + (high - low) // 3, low + 2 * ((high - low) // 3)


@query(f"WITH {G.HOURS_SQL}, {MIDDLE_SQL} SELECT time, {SHOWN_SQL} FROM e, bounds WHERE time >= a AND time < b")
def edges_time_window(spark: SparkSession, folder: str) -> DataFrame:
    edges = G.hours(spark, folder)
    return shown(E.in_window(edges, *_middle(edges)), "time")


@query(f"WITH {G.FLAGS_SQL} SELECT {SHOWN_SQL} FROM e WHERE layer = 'R'")
def edges_layer(spark: SparkSession, folder: str) -> DataFrame:
    return shown(E.in_layer(G.flags(spark, folder), "R"))


@query(f"WITH {G.SUPPLIERS_SQL} SELECT {SHOWN_SQL} FROM e WHERE list_contains(nodes, 1)")
def incident_edges(spark: SparkSession, folder: str) -> DataFrame:
    return shown(E.incident_edges(G.suppliers(spark, folder), 1))


@query(f"WITH {G.PARTS_SQL} SELECT a.node, count(DISTINCT b.node) AS n_neighbors FROM i a JOIN i b ON a.edge_id = b.edge_id AND a.node <> b.node GROUP BY 1")
def neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return E.neighbors(G.parts(spark, folder)).groupBy("node").agg(F.count("*").alias("n_neighbors"))


DECLARED_SQL = "declared AS (SELECT DISTINCT idx AS node FROM hg_node_records WHERE idx IS NOT NULL)"


def _declared(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "hg_node_records").where("idx IS NOT NULL").select(F.col("idx").alias("node")).distinct()


@query(f"WITH {G.RECORDS_SQL}, {DECLARED_SQL} SELECT node FROM declared WHERE node NOT IN (SELECT node FROM i)")
def isolates(spark: SparkSession, folder: str) -> DataFrame:
    return E.isolates(G.records(spark, folder), _declared(spark, folder))


@query(f"WITH {G.RECORDS_SQL}, {DECLARED_SQL} SELECT node FROM declared WHERE node IN (SELECT node FROM i)")
def non_isolates(spark: SparkSession, folder: str) -> DataFrame:
    return E.non_isolates(G.records(spark, folder), _declared(spark, folder))


@query(f"WITH {G.RECORDS_SQL}, {DECLARED_SQL}, every AS (SELECT node FROM declared UNION SELECT node FROM i) SELECT node FROM every WHERE node NOT IN (SELECT node FROM i WHERE size > 1)")
def isolated_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return E.isolated_nodes(G.records(spark, folder), _declared(spark, folder))


@query(f"WITH {G.PARTS_SQL} SELECT node, array_to_string(list_sort(list(edge_id)), '|') AS edge_ids FROM i GROUP BY node")
def edges_by_node(spark: SparkSession, folder: str) -> DataFrame:
    return E.edges_by_node(G.parts(spark, folder)).select("node", label(F.col("edge_ids")).alias("edge_ids"))


KEPT_PARTS_SQL = "kept AS (SELECT p_partkey AS node FROM part WHERE p_size <= 35)"


@query(f"WITH {G.PARTS_SQL}, {KEPT_PARTS_SQL} SELECT {SHOWN_SQL} FROM e WHERE edge_id NOT IN (SELECT edge_id FROM i WHERE node NOT IN (SELECT node FROM kept))")
def subhypergraph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    kept = table(spark, folder, "part").where("p_size <= 35").select(F.col("p_partkey").alias("node"))
    return shown(E.induced(G.parts(spark, folder), kept))


def _part_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("node"), "p_brand", "p_size")


@query(
    f"""WITH {G.PARTS_SQL}, bad AS (SELECT i.node FROM i LEFT JOIN part ON p_partkey = node WHERE NOT coalesce(p_size <= 40 AND p_size >= 3, false))
SELECT {SHOWN_SQL} FROM e WHERE size IN (2, 3) AND edge_id NOT IN (SELECT edge_id FROM i WHERE node IN (SELECT node FROM bad))"""
)
def filter_keep_all(spark: SparkSession, folder: str) -> DataFrame:
    edges, _ = E.filter_hypergraph(G.parts(spark, folder), _part_nodes(spark, folder), node_criteria={"p_size": lambda c: c.between(3, 40)}, edge_criteria={"size": [2, 3]})
    return shown(edges)


@query(
    f"""WITH {G.PARTS_SQL}, bad AS (SELECT i.node FROM i JOIN part ON p_partkey = node WHERE p_size = 7 OR p_size IN (11, 12))
SELECT {SHOWN_SQL} FROM e WHERE NOT (size = 1 OR weight > 1) AND edge_id NOT IN (SELECT edge_id FROM i WHERE node IN (SELECT node FROM bad))"""
)
def filter_remove_any(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _part_nodes(spark, folder).withColumn("again", F.col("p_size"))
    edges, _ = E.filter_hypergraph(
        G.parts(spark, folder), nodes, mode="remove", node_criteria={"p_size": 7, "again": [11, 12]}, node_mode="any", edge_criteria={"size": 1, "weight": lambda c: c > 1}, edge_mode="any"
    )
    return shown(edges)


@query(f"WITH {G.RECORDS_SQL} SELECT '' AS violation, 0 AS n WHERE false")
def invariants(spark: SparkSession, folder: str) -> DataFrame:
    return E.invariant_violations(G.records(spark, folder))


# -- windows and conversions


@query(f"WITH {G.HOURS_SQL} SELECT time // 24 AS \"window\", array_to_string(nodes, '|') AS nodes, size, sum(weight) AS weight FROM e GROUP BY 1, e.nodes, size")
def aggregate_windows(spark: SparkSession, folder: str) -> DataFrame:
    return shown(E.tumbling_windows(G.hours(spark, folder), 24), "window")


@query(
    """WITH stored AS (SELECT time_tick AS time, edge_id FROM hg_edges WHERE time_tick IS NOT NULL AND len(list_filter(interaction, lambda x: x IS NOT NULL)) > 0),
firsts AS (SELECT min(time) AS time, edge_id FROM stored GROUP BY edge_id), ticks AS (SELECT time // 6 AS w, count(*) AS n FROM firsts GROUP BY 1)
SELECT r.w AS "window", coalesce(n, 0) AS n_records FROM range(0, (SELECT max(w) + 1 FROM ticks)) r(w) LEFT JOIN ticks USING (w)"""
)
def window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 6 ticks over the records, empty ones included."""
    rows = table(spark, folder, "hg_edges").where("time_tick IS NOT NULL").select("edge_id", F.col("time_tick").alias("time"), canonical(F.col("interaction")).alias("nodes"))
    firsts = rows.where("size(nodes) > 0").groupBy("edge_id").agg(F.min("time").alias("time"))
    edges = firsts.select("edge_id", "time", F.array("edge_id").alias("nodes"), F.lit(1.0).alias("weight"))
    return E.window_counts(edges, 6).select("window", F.col("n_edges").alias("n_records"))


@query(f"WITH {G.HOURS_SQL} SELECT time, count(*) AS n_edges, max(size) AS largest FROM e GROUP BY time")
def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return E.snapshots(G.hours(spark, folder)).groupBy("time").agg(F.count("*").alias("n_edges"), F.max("size").alias("largest"))


FLAT_SQL = "SELECT array_to_string(nodes, '|') AS nodes, len(nodes) AS size, round(sum(weight), 6) AS weight FROM e GROUP BY e.nodes"


@query(f"WITH {G.HOURS_SQL} {FLAT_SQL}")
def temporal_to_hypergraph(spark: SparkSession, folder: str) -> DataFrame:
    return shown(E.to_undirected(G.hours(spark, folder)))


@query(f"WITH {G.FLOWS_SQL} {FLAT_SQL}")
def directed_to_hypergraph(spark: SparkSession, folder: str) -> DataFrame:
    return shown(E.to_undirected(G.flows(spark, folder)))


@query(f"WITH {G.FLAGS_SQL} {FLAT_SQL}")
def multiplex_to_hypergraph(spark: SparkSession, folder: str) -> DataFrame:
    return shown(E.to_undirected(G.flags(spark, folder)))


@query(f"WITH {G.FLAGS_SQL} SELECT array_to_string(nodes, '|') AS nodes, sum(weight) AS overlap FROM e GROUP BY e.nodes")
def edge_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return E.edge_overlap(G.flags(spark, folder)).select(label(F.col("nodes")).alias("nodes"), "overlap")


# -- degrees and directed measures


@query(f"WITH {G.RECORDS_SQL} SELECT node, count(*) AS degree FROM i GROUP BY node")
def degree_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return D.degrees(G.records(spark, folder))


@query(f"WITH {G.RECORDS_SQL}, d AS (SELECT node, count(*) AS degree FROM i GROUP BY node) SELECT degree, count(*) AS n_nodes FROM d GROUP BY degree")
def degree_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return D.degree_distribution(G.records(spark, folder))


@query(f"WITH {G.RECORDS_SQL}, n AS (SELECT DISTINCT node FROM i), d AS (SELECT n.node, count(i.node) AS degree FROM n LEFT JOIN i ON i.node = n.node AND i.size = 3 GROUP BY 1) SELECT degree, count(*) AS n_nodes FROM d GROUP BY degree")
def degree_distribution_size3(spark: SparkSession, folder: str) -> DataFrame:
    return D.degree_distribution(G.records(spark, folder), size=3)


@query(
    f"""WITH {G.PARTS_SQL}, n AS (SELECT DISTINCT node FROM i), s AS (SELECT DISTINCT size FROM e WHERE size >= 2),
d AS (SELECT n.node, s.size, count(i.node)::DOUBLE AS d FROM n CROSS JOIN s LEFT JOIN i ON i.node = n.node AND i.size = s.size GROUP BY ALL)
SELECT a.size AS size_a, b.size AS size_b, CASE WHEN stddev_pop(a.d) > 0 AND stddev_pop(b.d) > 0 THEN round(corr(a.d, b.d), 6) + 0.0 END AS correlation
FROM d a JOIN d b ON a.node = b.node AND a.size <= b.size GROUP BY ALL"""
)
def degree_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(D.degree_correlation(G.parts(spark, folder)), "correlation")


@query(f"WITH {G.FLOWS_SQL}, n AS (SELECT DISTINCT unnest(nodes) AS node FROM e), t AS (SELECT unnest(tgt) AS node FROM e) SELECT n.node, count(t.node) AS degree FROM n LEFT JOIN t USING (node) GROUP BY 1")
def in_degree(spark: SparkSession, folder: str) -> DataFrame:
    return D.in_degrees(G.flows(spark, folder))


@query(f"WITH {G.FLOWS_SQL}, n AS (SELECT DISTINCT unnest(nodes) AS node FROM e), t AS (SELECT unnest(src) AS node FROM e) SELECT n.node, count(t.node) AS degree FROM n LEFT JOIN t USING (node) GROUP BY 1")
def out_degree(spark: SparkSession, folder: str) -> DataFrame:
    return D.out_degrees(G.flows(spark, folder))


@query(
    f"""WITH {G.FLOWS_SQL}, k AS (SELECT max(size) - 1 AS top FROM e), g AS (SELECT a.x AS n_sources, b.x AS n_targets FROM range(1, (SELECT top + 1 FROM k)) a(x), range(1, (SELECT top + 1 FROM k)) b(x))
SELECT n_sources, n_targets, count(e.edge_id) AS n_edges FROM g LEFT JOIN e ON len(src) = n_sources AND len(tgt) = n_targets GROUP BY ALL"""
)
def signature(spark: SparkSession, folder: str) -> DataFrame:
    return D.signature(G.flows(spark, folder))


SHARE_SQL = "SELECT s.size, coalesce(round(avg(CASE WHEN e.edge_id IS NULL THEN NULL WHEN g.edge_id IS NULL THEN 0.0 ELSE 1.0 END), 6), 0.0) AS reciprocity FROM range(2, (SELECT max(size) + 1 FROM e)) s(size) LEFT JOIN e ON e.size = s.size LEFT JOIN good g ON g.edge_id = e.edge_id GROUP BY 1"
ARCS_SQL = "arcs AS (SELECT DISTINCT s, unnest(tgt) AS t FROM (SELECT unnest(src) AS s, tgt FROM e)), need AS (SELECT edge_id, t, unnest(tgt) AS s FROM (SELECT edge_id, unnest(src) AS t, tgt FROM e))"


def _reciprocity(measure, spark: SparkSession, folder: str) -> DataFrame:
    """A reciprocity of all sizes that there are."""
    edges = cut(G.flows(spark, folder))
    return rounded(measure(edges, max(2, edges.agg(F.max("size")).first()[0] or 0)), "reciprocity")


@query(f"WITH {G.FLOWS_SQL}, good AS (SELECT a.edge_id FROM e a JOIN e b ON a.src = b.tgt AND a.tgt = b.src) {SHARE_SQL}")
def exact_reciprocity(spark: SparkSession, folder: str) -> DataFrame:
    return _reciprocity(D.exact_reciprocity, spark, folder)


@query(f"WITH {G.FLOWS_SQL}, {ARCS_SQL}, met AS (SELECT DISTINCT edge_id, need.t FROM need JOIN arcs USING (s, t)), good AS (SELECT m.edge_id FROM met m JOIN e USING (edge_id) GROUP BY m.edge_id, len(src) HAVING count(*) = len(src)) {SHARE_SQL}")
def strong_reciprocity(spark: SparkSession, folder: str) -> DataFrame:
    return _reciprocity(D.strong_reciprocity, spark, folder)


@query(f"WITH {G.FLOWS_SQL}, {ARCS_SQL}, good AS (SELECT DISTINCT edge_id FROM need JOIN arcs USING (s, t)) {SHARE_SQL}")
def weak_reciprocity(spark: SparkSession, folder: str) -> DataFrame:
    return _reciprocity(D.weak_reciprocity, spark, folder)


# -- projections


@query(f"WITH {G.SUPPLIERS_SQL} SELECT a.node AS a, b.node AS b FROM i a JOIN i b ON a.edge_id = b.edge_id AND a.node < b.node GROUP BY ALL")
def clique_projection(spark: SparkSession, folder: str) -> DataFrame:
    return P.clique(G.suppliers(spark, folder))


@query(f"WITH {G.RECORDS_SQL} SELECT edge_id, node FROM i")
def bipartite_projection(spark: SparkSession, folder: str) -> DataFrame:
    return P.bipartite(G.records(spark, folder))


MET_SQL = "met AS (SELECT a.edge_id AS edge_a, b.edge_id AS edge_b, count(*) AS c, any_value(a.size) AS na, any_value(b.size) AS nb FROM i a JOIN i b ON a.node = b.node AND a.edge_id < b.edge_id GROUP BY ALL)"


@query(f"WITH {G.PARTS_SQL}, {MET_SQL} SELECT edge_a, edge_b, c::DOUBLE AS w FROM met WHERE c >= 2")
def line_graph_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return P.line_graph(G.parts(spark, folder), s=2)


@query(f"WITH {G.PARTS_SQL}, {MET_SQL} SELECT edge_a, edge_b, round(c / (na + nb - c), 6) AS w FROM met WHERE c / (na + nb - c) >= 0.3")
def line_graph_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.line_graph(G.parts(spark, folder), distance="jaccard", s=0.3), "w")


@query(
    f"""WITH {G.FLOWS_SQL}, a AS (SELECT edge_id, unnest(tgt) AS node FROM e), b AS (SELECT edge_id, unnest(src) AS node FROM e)
SELECT a.edge_id AS edge_a, count(*) AS n_edges FROM a JOIN b ON a.node = b.node AND a.edge_id <> b.edge_id GROUP BY 1"""
)
def directed_line_graph(spark: SparkSession, folder: str) -> DataFrame:
    return P.directed_line_degrees(cut(G.flows(spark, folder)))


@query(
    f"""WITH {G.PARTS_SQL}, masks AS (SELECT nodes, unnest(range(0, 1 << len(nodes))) AS m FROM e),
faces AS (SELECT DISTINCT list_filter(nodes, lambda x, k: (m >> (k - 1)) & 1 = 1) AS face FROM masks) SELECT len(face) AS size, count(*) AS n_faces FROM faces GROUP BY 1"""
)
def simplicial_closure(spark: SparkSession, folder: str) -> DataFrame:
    return P.simplicial_complex(G.parts(spark, folder)).groupBy(F.size("nodes").alias("size")).agg(F.count("*").alias("n_faces"))


# -- matrices


@query(f"WITH {G.RECORDS_SQL} SELECT node, edge_id, weight AS val, size - 1 AS \"order\" FROM i")
def incidence_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return M.incidence(G.records(spark, folder))


PAIRED_SQL = "paired AS (SELECT a.node AS row, b.node AS col, a.size, a.weight FROM i a JOIN i b ON a.edge_id = b.edge_id AND a.node <> b.node)"


@query(f"WITH {G.SUPPLIERS_SQL}, {PAIRED_SQL} SELECT row, col, count(*) AS val FROM paired GROUP BY ALL")
def adjacency_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return M.adjacency(G.suppliers(spark, folder))


@query(f"WITH {G.PARTS_SQL}, {PAIRED_SQL} SELECT row, col, sum(weight * weight) AS val FROM paired WHERE size = 3 GROUP BY ALL")
def adjacency_by_order(spark: SparkSession, folder: str) -> DataFrame:
    return M.adjacency(G.parts(spark, folder), weighted=True, order=2)


@query(f"WITH {G.PARTS_SQL}, pairs AS (SELECT DISTINCT a.edge_id AS row, b.edge_id AS col FROM i a JOIN i b ON a.node = b.node) SELECT row, count(*) AS n_entries FROM pairs GROUP BY row")
def dual_random_walk(spark: SparkSession, folder: str) -> DataFrame:
    return M.dual_adjacency(G.parts(spark, folder)).groupBy("row").agg(F.sum("val").alias("n_entries"))


LAPLACE_SQL = "SELECT node AS row, node AS col, 3.0 * count(*) - sum(weight * weight) AS val FROM i WHERE size = 3 GROUP BY node UNION ALL SELECT row, col, -sum(weight * weight) FROM paired WHERE size = 3 GROUP BY row, col"


@query(f"WITH {G.PARTS_SQL}, {PAIRED_SQL} {LAPLACE_SQL}")
def laplacian_by_order(spark: SparkSession, folder: str) -> DataFrame:
    return M.laplacian(G.parts(spark, folder), 2)


@query(
    f"""WITH {G.SUPPLIERS_SQL}, {PAIRED_SQL}, means AS (SELECT size, sum(size) / (SELECT count(DISTINCT node) FROM i) AS mean FROM e GROUP BY size),
parts AS (SELECT node AS row, node AS col, size, size * count(*) - sum(weight * weight) AS val FROM i WHERE size BETWEEN 2 AND 4 GROUP BY node, size
  UNION ALL SELECT row, col, size, -sum(weight * weight) FROM paired WHERE size BETWEEN 2 AND 4 GROUP BY ALL)
SELECT row, col, round(sum([1.0, 0.5, 2.0][size - 1] * val / mean), 6) AS val FROM parts JOIN means USING (size) GROUP BY ALL"""
)
def multiorder_laplacian(spark: SparkSession, folder: str) -> DataFrame:
    edges = G.suppliers(spark, folder)
    return rounded(M.multiorder_laplacian(edges, [1.0, 0.5, 2.0], E.node_table(edges).count()), "val")


@query(f"WITH {G.SUPPLIERS_SQL}, {PAIRED_SQL}, m AS (SELECT row, col, count(*) AS val FROM paired GROUP BY ALL) SELECT row AS node, round(sum(val ** 2.0), 3) AS factor FROM m GROUP BY row")
def adjacency_factor(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.adjacency_factor(M.adjacency(G.suppliers(spark, folder)), 2), "factor", digits=3)


TIMED_SQL = "timed AS (SELECT a.time, a.node AS row, b.node AS col, count(*) AS val FROM i a JOIN i b ON a.edge_id = b.edge_id AND a.node <> b.node GROUP BY ALL)"


@query(f"WITH {G.HOURS_SQL}, {TIMED_SQL} SELECT time, row, col, val FROM timed")
def temporal_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return M.temporal_adjacency(G.hours(spark, folder))


@query(f"WITH {G.HOURS_SQL}, {TIMED_SQL} SELECT row, col, round(sum(val) / (SELECT count(DISTINCT time) FROM e), 9) AS val FROM timed GROUP BY ALL")
def annealed_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.annealed_adjacency(G.hours(spark, folder)), "val", digits=9)


@query(
    f"WITH {G.SUPPLIERS_SQL}, {PAIRED_SQL}, m AS (SELECT row, col, sum(size - 1)::DOUBLE AS v FROM paired GROUP BY ALL) SELECT row, col, round(v / sum(v) OVER (PARTITION BY row), 9) AS val FROM m"
)
def transition_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.transition_matrix(G.suppliers(spark, folder)), "val", digits=9)
