"""Queries of paths, dynamics, centralities, validation, motifs, models and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.functions.columns import label
from polyad.operators import centrality as C
from polyad.operators import communities as K
from polyad.operators import correlation as R
from polyad.operators import degree as D
from polyad.operators import dynamics as Y
from polyad.operators import edges as E
from polyad.operators import generators as N
from polyad.operators import motifs as O
from polyad.operators import paths as P
from polyad.operators import reducibility as U
from polyad.operators import validation as V
from polyad.operators.projections import node_pairs
from polyad.plans import graphs as G
from polyad.plans.registry import Registry
from polyad.plans.structure import PAIRED_SQL, rounded
from polyad.plans.tables import table
from polyad.runtime import cut

REGISTRY = Registry()
query = REGISTRY.query

# -- components and reach

STARS_SQL = """links AS (SELECT node AS u, least_node AS v FROM stars WHERE node <> least_node UNION SELECT least_node, node FROM stars WHERE node <> least_node),
walk(node, seen) USING KEY (node) AS (
  SELECT u, u FROM links UNION SELECT l.v, min(w.seen) FROM walk w JOIN links l ON l.u = w.node JOIN recurring.walk r ON r.node = l.v WHERE w.seen < r.seen GROUP BY l.v),
components AS (SELECT n.node, coalesce(w.seen, n.node) AS component FROM (SELECT DISTINCT node FROM stars) n LEFT JOIN walk w ON w.node = n.node)"""


@query(f"WITH RECURSIVE {G.RECORDS_SQL}, stars AS (SELECT node, min(node) OVER (PARTITION BY edge_id) AS least_node FROM i), {STARS_SQL} SELECT node, component FROM components")
def connected_components(spark: SparkSession, folder: str) -> DataFrame:
    return P.connected_components(G.records(spark, folder))


@query(
    f"""WITH RECURSIVE stars AS (SELECT node, min(node) OVER (PARTITION BY edge) AS least_node FROM hif_incidences WHERE edge IS NOT NULL AND node IS NOT NULL), {STARS_SQL},
sizes AS (SELECT component, count(*) AS n_nodes FROM components GROUP BY component) SELECT n_nodes, count(*) AS n_components FROM sizes GROUP BY n_nodes"""
)
def component_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the incidences as they were delivered."""
    rows = table(spark, folder, "hif_incidences").where("edge IS NOT NULL AND node IS NOT NULL").groupBy(F.col("edge").alias("seq")).agg(F.collect_set("node").alias("nodes"))
    return P.component_sizes(P.connected_components(E.upsert(rows))).groupBy("n_nodes").agg(F.count("*").alias("n_components"))


@query(
    f"""WITH RECURSIVE {G.PARTS_SQL}, reached(node, hops) USING KEY (node) AS (
  SELECT 1::BIGINT, 0 UNION SELECT b.node, min(r.hops) + 1 FROM reached r JOIN i a ON a.node = r.node JOIN i b ON b.edge_id = a.edge_id LEFT JOIN recurring.reached x ON x.node = b.node WHERE x.node IS NULL GROUP BY b.node)
SELECT node, hops FROM reached"""
)
def bfs_hops(spark: SparkSession, folder: str) -> DataFrame:
    return P.reach(G.parts(spark, folder), spark.createDataFrame([(1,)], "node bigint"))


@query(
    f"""WITH RECURSIVE {G.FLOWS_SQL}, flat AS (SELECT nodes, len(nodes) AS size FROM e GROUP BY nodes),
views AS (SELECT 'all' AS projection, nodes, size FROM flat UNION ALL SELECT 'dyads', nodes, size FROM flat WHERE size = 2 UNION ALL SELECT 'higher', nodes, size FROM flat WHERE size >= 3),
firsts AS (SELECT projection, nodes, size, unnest(nodes) AS a FROM views), pairs AS (SELECT projection, size, a, unnest(nodes) AS b FROM firsts),
steps AS (SELECT projection, a, b, min(size)::DOUBLE AS size FROM pairs WHERE a <> b GROUP BY ALL),
walk(projection, a, b, hops, path, total) USING KEY (projection, a, b) AS (
  SELECT projection, a, b, 1, [a, b], size FROM steps
  UNION SELECT w.projection, w.a, s.b, min(w.hops) + 1, min(list_append(w.path, s.b)), arg_min(w.total + s.size, list_append(w.path, s.b))
  FROM walk w JOIN steps s ON s.projection = w.projection AND s.a = w.b LEFT JOIN recurring.walk x ON x.projection = w.projection AND x.a = w.a AND x.b = s.b
  WHERE x.a IS NULL AND s.b <> w.a GROUP BY w.projection, w.a, s.b)
SELECT projection, a, b, hops, round(total / hops, 6) AS mean_size FROM walk"""
)
def shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    found = P.projected_paths(G.flows(spark, folder).transform(E.to_undirected))
    return found.select("projection", "a", "b", "hops", F.round("mean_size", 6).alias("mean_size"))


@query(
    f"""WITH {G.FLOWS_SQL}, flat AS (SELECT nodes, len(nodes) AS size FROM e GROUP BY nodes), m AS (SELECT nodes, size, unnest(nodes) AS a FROM flat), p AS (SELECT nodes, size, a, unnest(nodes) AS b FROM m)
SELECT a, b, min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS mean_size, count(*) - 1 AS redundancy FROM p WHERE a < b GROUP BY a, b"""
)
def step_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.step_sizes(E.to_undirected(G.flows(spark, folder))), "mean_size")


@query(
    f"""WITH {G.HOURS_SQL}, active AS (SELECT DISTINCT time, node FROM i), coming AS (SELECT time, node, lead(time) OVER (PARTITION BY node ORDER BY time) AS to_time FROM active),
near AS (SELECT DISTINCT a.time, a.node, b.node AS to_node FROM i a JOIN i b ON a.edge_id = b.edge_id)
SELECT n.time, n.node, c.to_time, n.to_node, c.to_time - n.time AS delay FROM near n JOIN coming c ON c.time = n.time AND c.node = n.to_node WHERE c.to_time IS NOT NULL"""
)
def supra_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    return P.supra_adjacency(G.hours(spark, folder))


#: Nations are few: sets of them are bits of a number, and what is reached from a set are the sets that share a bit.
REACHED_SQL = """flat AS (SELECT DISTINCT nodes FROM e), bits AS (SELECT nodes, list_sum(list_transform(nodes, lambda x: 1::BIGINT << x))::BIGINT AS m FROM flat),
r0 AS (SELECT DISTINCT m FROM starts), r1 AS (SELECT r.m, count(*) AS n, bit_or(b.m) AS next FROM r0 r JOIN bits b ON r.m & b.m <> 0 GROUP BY r.m),
r2 AS (SELECT r.m, count(*) AS n, bit_or(b.m) AS next FROM (SELECT DISTINCT next AS m FROM r1) r JOIN bits b ON r.m & b.m <> 0 GROUP BY r.m),
r3 AS (SELECT r.m, count(*) AS n, bit_or(b.m) AS next FROM (SELECT DISTINCT next AS m FROM r2) r JOIN bits b ON r.m & b.m <> 0 GROUP BY r.m),
far AS (SELECT r1.m, r1.n AS n1, r2.n AS n2, r3.n AS n3, bit_count(r1.m) AS v0, bit_count(r1.next) AS v1, bit_count(r2.next) AS v2, bit_count(r3.next) AS v3 FROM r1 JOIN r2 ON r2.m = r1.next JOIN r3 ON r3.m = r2.next)"""


@query(
    f"""WITH {G.FLOWS_SQL}, starts AS (SELECT DISTINCT 1::BIGINT << node AS m, node FROM (SELECT unnest(nodes) AS node FROM e)), {REACHED_SQL},
scored AS (SELECT s.node, n1 + 3 * (n2 - n1) + 5 * (n3 - n2) + 2 * (v1 - v0) + 4 * (v2 - v1) + 6 * (v3 - v2) AS total, n3 + v3 - 1 AS reached FROM far JOIN starts s USING (m)),
whole AS (SELECT (SELECT count(*) FROM bits) + (SELECT count(*) FROM starts) - 1 AS others) SELECT node::VARCHAR AS node, round(reached / total * reached / others, 6) AS closeness FROM scored, whole"""
)
def node_closeness(spark: SparkSession, folder: str) -> DataFrame:
    nations = cut(E.to_undirected(G.flows(spark, folder)))
    return rounded(P.node_path_scores(nations, "closeness"), "closeness")


@query(
    f"""WITH {G.FLOWS_SQL}, starts AS (SELECT DISTINCT list_sum(list_transform(nodes, lambda x: 1::BIGINT << x))::BIGINT AS m FROM e), {REACHED_SQL},
scored AS (SELECT b.nodes, (n1 - 1) + 2 * (n2 - n1) + 3 * (n3 - n2) AS total, n3 - 1 AS reached FROM far JOIN bits b USING (m))
SELECT array_to_string(nodes, '|') AS edge, coalesce(round(reached / total * reached / ((SELECT count(*) FROM bits) - 1), 6), 0.0) AS closeness FROM scored"""
)
def s_closeness(spark: SparkSession, folder: str) -> DataFrame:
    nations = cut(E.to_undirected(G.flows(spark, folder)))
    scored = P.edge_path_scores(nations, "closeness").join(nations.select("edge_id", "nodes"), "edge_id")
    return rounded(scored.select(label(F.col("nodes")).alias("edge"), "closeness"), "closeness")


#: Betweenness of ``vertices`` (v) by ``links`` (u, v in both directions): all shortest paths and how many of them lead over each vertex.
BETWEEN_SQL = """walk(a, b, hops, ways) USING KEY (a, b) AS (
  SELECT v, v, 0, 1.0::DOUBLE FROM vertices
  UNION SELECT w.a, l.v, min(w.hops) + 1, sum(w.ways) FROM walk w JOIN links l ON l.u = w.b LEFT JOIN recurring.walk x ON x.a = w.a AND x.b = l.v WHERE x.a IS NULL GROUP BY w.a, l.v),
over AS (SELECT x.b AS v, sum(x.ways * y.ways / w.ways) AS s FROM walk w JOIN walk x ON x.a = w.a JOIN walk y ON y.a = x.b AND y.b = w.b WHERE w.a <> w.b AND x.b <> w.a AND x.b <> w.b AND x.hops + y.hops = w.hops GROUP BY x.b),
n AS (SELECT count(*) AS n FROM vertices)"""


@query(
    f"""WITH RECURSIVE {G.KINDS_SQL}, vertices AS (SELECT edge_id AS v FROM e), links AS (SELECT a.edge_id AS u, b.edge_id AS v FROM i a JOIN i b ON a.node = b.node AND a.edge_id <> b.edge_id GROUP BY ALL HAVING count(*) >= 2), {BETWEEN_SQL}
SELECT array_to_string(nodes, '|') AS edge, round(coalesce(s, 0) / ((n - 1) * (n - 2)), 6) AS betweenness FROM e CROSS JOIN n LEFT JOIN over ON v = edge_id"""
)
def s_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.kinds(spark, folder))
    scored = P.edge_path_scores(edges, "betweenness", s=2).join(edges.select("edge_id", "nodes"), "edge_id")
    return rounded(scored.select(label(F.col("nodes")).alias("edge"), "betweenness"), "betweenness")


@query(
    f"""WITH RECURSIVE {G.KINDS_SQL}, named AS (SELECT 'E' || edge_id AS e, 'N' || node AS v FROM i), vertices AS (SELECT DISTINCT e AS v FROM named UNION SELECT v FROM named), links AS (SELECT e AS u, v FROM named UNION SELECT v, e FROM named), {BETWEEN_SQL}
SELECT substr(v.v, 2) AS node, round(coalesce(s, 0) / ((n - 1) * (n - 2)), 6) AS betweenness FROM vertices v CROSS JOIN n LEFT JOIN over USING (v) WHERE v.v LIKE 'N%'"""
)
def node_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(P.node_path_scores(cut(G.kinds(spark, folder)), "betweenness"), "betweenness")


@query(
    f"""WITH RECURSIVE {G.KINDS_SQL}, ways AS (SELECT DISTINCT d AS time, edge_id, node FROM daily JOIN e ON e.nodes = daily.nodes, unnest(e.nodes) u(node)),
vertices AS (SELECT DISTINCT time || ':' || edge_id AS v FROM ways), links AS (SELECT DISTINCT a.time || ':' || a.edge_id AS u, b.time || ':' || b.edge_id AS v FROM ways a JOIN ways b ON a.time = b.time AND a.node = b.node AND a.edge_id <> b.edge_id),
walk(a, b, hops) USING KEY (a, b) AS (SELECT v, v, 0 FROM vertices UNION SELECT w.a, l.v, min(w.hops) + 1 FROM walk w JOIN links l ON l.u = w.b LEFT JOIN recurring.walk x ON x.a = w.a AND x.b = l.v WHERE x.a IS NULL GROUP BY w.a, l.v),
sizes AS (SELECT split_part(v, ':', 1) AS time, count(*) AS n FROM vertices GROUP BY 1), scored AS (SELECT split_part(a, ':', 1) AS time, split_part(a, ':', 2)::BIGINT AS edge_id, count(*) - 1 AS r, sum(hops) AS total FROM walk GROUP BY a)
SELECT array_to_string(any_value(e.nodes), '|') AS edge, round(sum(CASE WHEN total > 0 THEN r / total * r / greatest(1, n - 1) ELSE 0 END) / (SELECT count(*) FROM sizes), 6) AS closeness FROM scored JOIN sizes USING (time) JOIN e USING (edge_id) GROUP BY edge_id"""
)
def averaged_closeness(spark: SparkSession, folder: str) -> DataFrame:
    """Closeness of sets of event types in the hypergraph of each day, the mean over the days."""
    return rounded(P.averaged_path_scores(cut(G.daily_kinds(spark, folder)), "closeness"), "closeness")


# -- random walks and contagion

MOVES_SQL = f"{PAIRED_SQL}, m AS (SELECT row, col, sum(size - 1)::DOUBLE AS v FROM paired GROUP BY ALL), p AS (SELECT row, col, v / sum(v) OVER (PARTITION BY row) AS val FROM m)"


@query(f"WITH {G.PARTS_SQL}, {MOVES_SQL} SELECT row AS node, round(sum(v) / (SELECT sum(v) FROM m), 9) AS density FROM m GROUP BY row")
def rw_stationary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(Y.walk_stationary(G.parts(spark, folder)), "density", digits=9)


@query(
    f"""WITH {G.SUPPLIERS_SQL}, {MOVES_SQL}, d0 AS (SELECT min(node) AS node, 1.0::DOUBLE AS density FROM i),
d1 AS (SELECT col AS node, sum(density * val) AS density FROM d0 JOIN p ON node = row GROUP BY col), d2 AS (SELECT col AS node, sum(density * val) AS density FROM d1 JOIN p ON node = row GROUP BY col)
SELECT 0 AS step, node, density FROM d0 UNION ALL SELECT 1, node, round(density, 9) FROM d1 UNION ALL SELECT 2, node, round(density, 9) FROM d2"""
)
def rw_density(spark: SparkSession, folder: str) -> DataFrame:
    edges = G.suppliers(spark, folder)
    start = edges.agg(F.min(F.array_min("nodes")).alias("node")).withColumn("density", F.lit(1.0))
    return rounded(Y.walk_density(edges, start, 2), "density", digits=9)


@query()
def contagion(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.parts(spark, folder))
    infected = E.node_table(edges).where("node % 10 = 0")
    return Y.contagion(edges, infected, 6, beta=0.2, beta_d=0.5, mu=0.1, seed=1)


def _spread_sql(steps: int) -> str:
    states = ["s0 AS (SELECT DISTINCT node FROM i WHERE node % 10 = 0)"]
    for k in range(1, steps):
        states.append(f"""s{k} AS MATERIALIZED (SELECT node FROM s{k - 1} UNION SELECT node FROM i WHERE size IN (2, 3) AND edge_id IN (
  SELECT edge_id FROM i WHERE size IN (2, 3) AND node IN (SELECT node FROM s{k - 1}) GROUP BY edge_id HAVING count(*) = any_value(size) - 1))""")
    shares = " UNION ALL ".join(f"SELECT {k} AS step, (SELECT count(*) FROM s{k}) / (SELECT count(DISTINCT node) FROM i) AS share" for k in range(steps))
    return ", ".join(states) + f" SELECT step, round(share, 9) AS share FROM ({shares})"


@query(f"WITH {G.PARTS_SQL}, {_spread_sql(6)}")
def contagion_certain(spark: SparkSession, folder: str) -> DataFrame:
    """Contagion that never fails and never heals."""
    edges = cut(G.parts(spark, folder))
    return rounded(Y.contagion(edges, E.node_table(edges).where("node % 10 = 0"), 6, beta=1.0, beta_d=1.0, mu=0.0, seed=1), "share", digits=9)


@query("SELECT * FROM (VALUES (40, 41, 0, true)) x(n_steps, n_nodes, n_jumps, again)")
def random_walk(spark: SparkSession, folder: str) -> DataFrame:
    """A walk of 40 steps: every step is along an edge, and the same seed walks the same way."""
    edges = cut(G.suppliers(spark, folder))
    path = Y.random_walk(edges, 1, 40, seed=3)
    steps = spark.createDataFrame(list(zip(path, path[1:])), "a bigint, b bigint").distinct()
    ends = steps.select("a", "b", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    pairs = node_pairs(edges).select(F.col("a").alias("low"), F.col("b").alias("high"))
    jumps = steps.count() - pairs.join(F.broadcast(ends), ["low", "high"]).select("a", "b").distinct().count()  # as many ends as steps
    return spark.createDataFrame([(len(path) - 1, len(path), jumps, path == Y.random_walk(edges, 1, 40, seed=3))], "n_steps int, n_nodes int, n_jumps bigint, again boolean")


@query("SELECT * FROM (VALUES (0.0, -1.0), (0.5, -1.5), (1.0, -2.0)) x(alpha, exponent)")
def master_stability(spark: SparkSession, folder: str) -> DataFrame:
    """A damped linear system, for which the exponent is -1 - alpha."""
    flat = lambda t, x: -x
    found = Y.master_stability(spark, flat, lambda x: -_eye(len(x)), lambda x: _eye(len(x)), [0.0, 0.5, 1.0], [1.0, 2.0], transient=1.0, time=20.0, step=0.05, cycles=20)
    return rounded(found, "exponent", digits=3)


def _eye(n: int):
    import numpy as np

    return np.eye(n)


# -- centralities


#: Rounds on the triples of parts: {step} gives y of every node; they end as the operator's do.
ROUNDS_SQL = """t AS (SELECT edge_id, node FROM i WHERE size = 3), n AS (SELECT DISTINCT node FROM t),
it(k, node, x, gap) AS (
  SELECT 0, node, {first}, 1.0::DOUBLE FROM n
  UNION ALL SELECT k, node, y / total, sqrt(sum((y / total - x) ** 2) OVER ()) FROM (
    SELECT k + 1 AS k, node, x, y, {norm} AS total FROM (
      SELECT any_value(w.k) AS k, w.node, any_value(w.x) AS x, {step} AS y FROM it w JOIN t ON t.node = w.node JOIN t o ON o.edge_id = t.edge_id AND o.node <> t.node JOIN t p ON p.edge_id = t.edge_id AND p.node <> t.node AND p.node <> o.node
      JOIN it wo ON wo.node = o.node JOIN it wp ON wp.node = p.node WHERE w.gap >= {tol} AND w.k < {most} AND o.node < p.node GROUP BY w.node)))
SELECT node, round(x, 6) AS centrality FROM it WHERE k = (SELECT max(k) FROM it)"""


def _rounds_sql(**parts) -> str:
    return f"WITH RECURSIVE {G.PARTS_SQL}, " + ROUNDS_SQL.format(**parts)


@query(_rounds_sql(first="1.0::DOUBLE / sqrt(count(*) OVER ())", norm="sqrt(sum(y * y) OVER ())", step="sum(wo.x + wp.x)", tol="1e-7", most=1000))
def clique_centrality(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.clique_centrality(E.by_size(G.parts(spark, folder), size=3)), "centrality")


@query(_rounds_sql(first="1.0::DOUBLE / count(*) OVER ()", norm="sum(y) OVER ()", step="sum(wo.x * wp.x)", tol="1e-7", most=1000))
def z_centrality(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.z_centrality(E.by_size(G.parts(spark, folder), size=3)), "centrality")


@query(_rounds_sql(first="1.0::DOUBLE / count(*) OVER ()", norm="sum(y) OVER ()", step="sqrt(sum(wo.x * wp.x))", tol="1e-6", most=100))
def h_centrality(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.h_centrality(E.by_size(G.parts(spark, folder), size=3)), "centrality")


@query()
def subhypergraph_centrality(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.subhypergraph_centrality(G.suppliers(spark, folder)), "centrality", digits=4)


# -- validation

TESTS_SQL = """k AS (SELECT size, node, sum(weight)::BIGINT AS k FROM i WHERE size BETWEEN 2 AND 10 GROUP BY ALL), n AS (SELECT size, sum(weight)::BIGINT AS n FROM e GROUP BY size)"""


@query(
    f"""WITH {G.PARTS_SQL}, {TESTS_SQL} SELECT e.size, array_to_string(any_value(nodes), '|') AS nodes, any_value(e.weight)::BIGINT AS n_observed, any_value(n.n) AS n_edges, round(sum(ln(k.k / n.n)), 6) AS log_p
FROM e JOIN i USING (edge_id) JOIN k ON k.size = e.size AND k.node = i.node JOIN n ON n.size = e.size WHERE e.size BETWEEN 2 AND 10 GROUP BY e.edge_id, e.size"""
)
def svh_counts(spark: SparkSession, folder: str) -> DataFrame:
    tests = V.edge_tests(G.parts(spark, folder))
    return tests.select("size", label(F.col("nodes")).alias("nodes"), "n_observed", "n_edges", F.round(F.log("expected_p"), 6).alias("log_p"))


#: p-values of ``tests`` (t, size, k, n, p, n_possible), whose terms far above the mean vanish, and the line that they step up to.
STEPPED_SQL = """grown AS (SELECT t, size, n_possible, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))) AS p FROM tests, unnest(range(k, least(n, k + 400) + 1)) r(j) WHERE p < 1 GROUP BY ALL
  UNION ALL SELECT t, size, n_possible, 1.0 FROM tests WHERE p >= 1),
ranked AS (SELECT *, (SELECT count(*) FROM grown o WHERE o.size = g.size AND o.p <= g.p) AS r FROM grown g),
lines AS (SELECT size, max(r * 0.01 / n_possible) AS line FROM ranked WHERE p < r * 0.01 / n_possible GROUP BY size)"""


@query(
    f"""WITH {G.RECORDS_SQL}, {TESTS_SQL}, c AS (SELECT size, count(*) AS nodes FROM k GROUP BY size),
tests AS (SELECT e.edge_id AS t, e.size, any_value(e.weight)::BIGINT AS k, any_value(n.n) AS n, exp(sum(ln(k.k / n.n))) AS p, exp(any_value(lgamma(c.nodes + 1) - lgamma(e.size + 1) - lgamma(c.nodes - e.size + 1))) AS n_possible
  FROM e JOIN i USING (edge_id) JOIN k ON k.size = e.size AND k.node = i.node JOIN n ON n.size = e.size JOIN c ON c.size = e.size WHERE e.size BETWEEN 2 AND 10 GROUP BY e.edge_id, e.size), {STEPPED_SQL}
SELECT e.size, array_to_string(nodes, '|') AS nodes, e.weight::BIGINT AS n_observed, round(log10(p), 4) AS log10_p, p < coalesce(line, 0) AS validated FROM grown JOIN e ON e.edge_id = t LEFT JOIN lines ON lines.size = e.size"""
)
def svh(spark: SparkSession, folder: str) -> DataFrame:
    found = V.validated_edges(G.records(spark, folder))
    return found.select("size", label(F.col("nodes")).alias("nodes"), "n_observed", F.round(F.log10("p_value"), 4).alias("log10_p"), "validated")


@query(
    f"""WITH {G.RECORDS_SQL}, whole AS (SELECT sum(weight)::BIGINT AS n FROM e), shares AS (SELECT node, sum(weight) / (SELECT n FROM whole) AS share FROM i GROUP BY node),
pairs AS (SELECT a.node AS a, b.node AS b, sum(a.weight)::BIGINT AS k FROM i a JOIN i b ON a.edge_id = b.edge_id AND a.node < b.node GROUP BY ALL),
tests AS (SELECT (a, b) AS t, 2 AS size, k, n, x.share * y.share AS p, (SELECT count(*) * (count(*) - 1) / 2 FROM shares) AS n_possible FROM pairs JOIN shares x ON x.node = a JOIN shares y ON y.node = b, whole), {STEPPED_SQL.replace("ranked AS (SELECT *, (SELECT count(*) FROM grown o WHERE o.size = g.size AND o.p <= g.p) AS r FROM grown g)", "ranked AS (SELECT *, count(*) OVER (PARTITION BY size ORDER BY p RANGE UNBOUNDED PRECEDING) AS r FROM grown)")}
SELECT pairs.a AS node_a, pairs.b AS node_b, pairs.k AS n_observed, round(log10(p), 3) AS log10_p FROM grown JOIN pairs ON (pairs.a, pairs.b) = t JOIN lines USING (size) WHERE p < line"""
)
def svc_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Validated groups of two nodes, of all records."""
    found = V.validated_cores(G.records(spark, folder), max_size=2)
    return found.select(F.col("nodes")[0].alias("node_a"), F.col("nodes")[1].alias("node_b"), "n_observed", F.round(F.log10("p_value"), 3).alias("log10_p"))


@query()
def svc(spark: SparkSession, folder: str) -> DataFrame:
    found = V.validated_cores(E.to_undirected(G.flows(spark, folder)))
    return found.select("size", label(F.col("nodes")).alias("nodes"), "n_observed", "p_value")


# -- motifs and reducibility


@query(
    f"""WITH {G.PARTS_SQL}, d AS (SELECT nodes[1] AS u, nodes[2] AS v FROM e WHERE size = 2), b AS (SELECT u, v FROM d UNION ALL SELECT v, u FROM d),
sets AS (SELECT nodes FROM e WHERE size = 3 UNION SELECT list_sort([x.u, x.v, y.v]) FROM b x JOIN b y ON x.u = y.u AND x.v < y.v),
counted AS (SELECT s.nodes, (SELECT count(*) FROM e WHERE e.nodes = s.nodes) AS t,
  (SELECT count(*) FROM d WHERE (u = s.nodes[1] AND v = s.nodes[2]) OR (u = s.nodes[1] AND v = s.nodes[3]) OR (u = s.nodes[2] AND v = s.nodes[3])) AS n FROM sets s),
kinds AS (SELECT * FROM (VALUES ('12 13', 0, 2), ('12 13 23', 0, 3), ('123', 1, 0), ('12 123', 1, 1), ('12 13 123', 1, 2), ('12 13 23 123', 1, 3)) x(pattern, t, n))
SELECT pattern, count(c.nodes) AS "count" FROM kinds k LEFT JOIN counted c ON c.t = k.t AND c.n = k.n GROUP BY pattern"""
)
def motifs_order3(spark: SparkSession, folder: str) -> DataFrame:
    return O.count_motifs(cut(G.parts(spark, folder)), 3)


@query()
def motifs_order4(spark: SparkSession, folder: str) -> DataFrame:
    return O.count_motifs(cut(G.parts(spark, folder)), 4)


@query(
    f"""WITH {G.FLOWS_SQL}, used AS (SELECT DISTINCT src, tgt, nodes FROM e WHERE len(src) > 0 AND len(tgt) > 0 AND len(nodes) <= 3),
sets AS (SELECT DISTINCT nodes FROM used WHERE len(nodes) = 3), arcs AS (SELECT s.nodes AS whole, u.src, u.tgt FROM sets s JOIN used u ON list_has_all(s.nodes, u.nodes)),
perms AS (SELECT [a, b, 6 - a - b] AS p FROM range(1, 4) x(a), range(1, 4) y(b) WHERE a <> b),
named AS (SELECT whole, p, array_to_string(list_sort(list_transform(src, lambda x: p[list_position(whole, x)])), '') || '>' || array_to_string(list_sort(list_transform(tgt, lambda x: p[list_position(whole, x)])), '') AS t FROM arcs, perms),
texts AS (SELECT whole, p, string_agg(t, ' ' ORDER BY t) AS text FROM named GROUP BY whole, p), least_of AS (SELECT whole, min(text) AS pattern FROM texts GROUP BY whole)
SELECT pattern, count(*) AS "count" FROM least_of GROUP BY pattern"""
)
def motifs_directed(spark: SparkSession, folder: str) -> DataFrame:
    return O.count_directed_motifs(cut(G.flows(spark, folder)), 3)


@query()
def motif_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(O.motif_profile(cut(G.parts(spark, folder)), 3), "z", "profile", "mean")


@query()
def reducibility(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.parts(spark, folder))
    costs = U.layer_costs(edges)
    eta, sizes = U.reducibility(edges, optimization="exact" if len(costs[0]) <= U.EXACT_LAYERS else "greedy", costs=costs)
    layers = U.layer_reducibility(edges, costs=costs)
    rows = [("all", float(eta), "|".join(map(str, sizes)))] + [(str(k), float(v), "") for k, v in layers.items()]
    return rounded(spark.createDataFrame(rows, "layer string, eta double, sizes string"), "eta")


# -- correlations


@query()
def temporal_correlation(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.hours(spark, folder))
    first, largest = edges.agg(F.min("time"), F.max("size")).first()
    found = R.correlation_table(edges.withColumn("time", F.col("time") - first), max(1, largest - 1), [0, 1])
    # significant digits: the factorials make values of large orders small
    return found.withColumn("correlation", F.format_string("%.8e", "correlation").cast("double"))


@query()
def event_distances(spark: SparkSession, folder: str) -> DataFrame:
    events = cut(G.hours(spark, folder))
    edges = cut(E.to_undirected(events))
    placed = events.select("time", "nodes", "size").join(edges.select("edge_id", "nodes"), "nodes")
    placed = cut(placed.select("time", "edge_id", "size"))
    return R.event_distances(placed, R.pair_distances(edges, R.near_pairs(placed, [2, 8, 24])), [2, 8, 24])


# -- models


@query()
def mixed_membership(spark: SparkSession, folder: str) -> DataFrame:
    found = K.fit_mixed_membership(cut(G.suppliers(spark, folder)), 2, n_iter=500, seed=1)
    return found.u.select("node", F.round(F.col("u")[0], 6).alias("u0"), F.round(F.col("u")[1], 6).alias("u1"))


@query()
def size_model(spark: SparkSession, folder: str) -> DataFrame:
    memberships, _, _ = K.fit_size_model(cut(G.kinds(spark, folder)), 2, seed=1)
    return memberships.select("node", F.round(F.col("u")[0], 6).alias("u0"), F.round(F.col("u")[1], 6).alias("u1"))


@query()
def spectral_communities(spark: SparkSession, folder: str) -> DataFrame:
    return K.spectral_communities(cut(G.suppliers(spark, folder)), 3, seed=1)


@query()
def core_periphery(spark: SparkSession, folder: str) -> DataFrame:
    nations = cut(E.to_undirected(G.flows(spark, folder)))
    return rounded(K.core_periphery(nations, seed=1), "coreness")


@query()
def edge_communities(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.kinds(spark, folder))
    found = K.edge_communities(edges, 0.7)
    return K.overlapping_communities(edges, found).select("node", F.size("communities").alias("n_communities"))


# -- generators: what must hold of their results, and what a copy of the input fails


def _changed(old: DataFrame, new: DataFrame, keys: list[str]) -> bool:
    """Whether more than half of the edges are no longer there."""
    return new.join(old.select(keys), keys, "left_anti").count() * 2 > new.count()


@query(f"WITH {G.PARTS_SQL} SELECT node, sum(weight)::BIGINT AS degree, true AS changed FROM i GROUP BY node")
def configuration_model(spark: SparkSession, folder: str) -> DataFrame:
    """Degrees with multiplicity, which the null model must leave as they are, and whether most edges are new."""
    edges = cut(G.parts(spark, folder))
    single = edges.select("edge_id", "nodes", "size", F.lit(1.0).alias("weight"), F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))).alias("copy"))
    single = cut(single.withColumn("edge_id", F.xxhash64("edge_id", "copy")).drop("copy"))
    mixed = cut(N.configuration_model(single, duplicate_output="count", seed=1))
    return E.incidences(mixed).groupBy("node").agg(F.sum("weight").cast("bigint").alias("degree")).withColumn("changed", F.lit(_changed(edges.where("size > 1"), mixed.where("size > 1"), ["nodes"])))


@query(f"WITH {G.PARTS_SQL} SELECT size, count(*) AS n_edges, size = 3 AS changed FROM e WHERE size > 1 GROUP BY size")
def configuration_vertex(spark: SparkSession, folder: str) -> DataFrame:
    """Triples mixed without ever making two equal; all other edges stay as they are."""
    edges = cut(G.parts(spark, folder).where("size > 1"))
    mixed = cut(N.configuration_model(edges, size=3, label="vertex", duplicate_output="error", seed=1))
    rows = [(r["size"], r["count"], _changed(edges, mixed.where(F.col("size") == r["size"]), ["nodes"])) for r in mixed.groupBy("size").count().collect()]  # a row per size
    return spark.createDataFrame(rows, "size int, n_edges bigint, changed boolean")


@query(f"WITH {G.FLOWS_SQL}, t AS (SELECT 'target' AS role, unnest(tgt) AS node, weight FROM e UNION ALL SELECT 'source', unnest(src), weight FROM e) SELECT role, node, count(*) AS degree, true AS changed FROM t GROUP BY role, node")
def directed_configuration_model(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut(G.flows(spark, folder).withColumn("weight", F.lit(1.0)))
    mixed = cut(N.directed_configuration_model(edges, seed=1))
    new = mixed.join(edges.select("src", "tgt"), ["src", "tgt"], "left_anti").count()
    return E.incidences(mixed).groupBy("role", "node").agg(F.sum("weight").cast("bigint").alias("degree")).withColumn("changed", F.lit(new * 10 > mixed.count()))


@query("SELECT * FROM (VALUES (2, 400), (3, 200), (5, 100)) s(size, most), (SELECT 0 AS n_bad, true AS close, true AS again)")
def random_hypergraph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges per size: as many draws as wanted, distinct nodes out of the range, few equal draws, and the same again from the same seed."""
    wanted = {2: 400, 3: 200, 5: 100}
    drawn = [cut(N.random_hypergraph(spark, 300, wanted, seed=1)) for _ in range(2)]
    bad = (F.size(F.array_distinct("nodes")) != F.col("size")) | (F.array_min("nodes") < 0) | (F.array_max("nodes") >= 300)
    same = drawn[0].join(drawn[1], "nodes", "left_anti").isEmpty()
    rows = drawn[0].groupBy("size").agg(F.count("*").alias("n"), F.sum(bad.cast("int")).alias("n_bad")).collect()  # a row per size
    return spark.createDataFrame([(r["size"], wanted[r["size"]], r.n_bad, wanted[r["size"]] * 0.97 <= r.n <= wanted[r["size"]], same) for r in rows], "size int, most int, n_bad bigint, close boolean, again boolean")


@query(f"WITH {G.PARTS_SQL} SELECT size, sum(weight) AS total, size = 4 AS changed FROM e WHERE size > 1 GROUP BY size")
def random_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """Weights per size stay; of the shuffled size about the wanted half of the edges are new, of the others none."""
    edges = cut(G.parts(spark, folder).where("size > 1"))
    mixed = cut(N.random_shuffle(edges, size=4, p=0.5, seed=1))
    new = mixed.join(edges.select("nodes"), "nodes", "left_anti").groupBy("size").agg(F.count("*").alias("new"))
    found = mixed.groupBy("size").agg(F.sum("weight").alias("total"), F.count("*").alias("n")).join(new, "size", "left")
    return found.select("size", "total", (F.coalesce("new", F.lit(0)).between(F.col("n") * 0.35, F.col("n") * 0.65) & (F.coalesce("new", F.lit(0)) > 0)).alias("changed"))


@query(f"WITH {G.PARTS_SQL} SELECT size, count(*) + CASE WHEN size = 3 THEN 50 ELSE 0 END AS total_edges FROM e GROUP BY size")
def random_added(spark: SparkSession, folder: str) -> DataFrame:
    """50 more triples of random nodes: weights of edges that were there, or edges that are new."""
    edges = cut(G.parts(spark, folder).withColumn("weight", F.lit(1.0)))
    mixed = N.add_random_edges(edges, E.node_table(edges), 3, 50, seed=1)
    return mixed.groupBy("size").agg(F.sum("weight").cast("bigint").alias("total_edges"))


@query("SELECT * FROM (VALUES (2, 1000, 0, true), (3, 500, 0, true)) x(size, n_edges, n_bad, skewed)")
def scale_free(spark: SparkSession, folder: str) -> DataFrame:
    """Exactly the wanted edges, of distinct nodes, with hubs far above the mean."""
    found = cut(N.scale_free(spark, 500, {2: 1000, 3: 500}, rho=0.5, seed=1))
    bad = F.size(F.array_distinct("nodes")) != F.col("size")
    top = D.degrees(found).agg(F.max("degree") > 5 * F.avg("degree")).first()[0]
    return found.groupBy("size").agg(F.count("*").alias("n_edges"), F.sum(bad.cast("int")).alias("n_bad")).withColumn("skewed", F.lit(top))


@query("SELECT * FROM (VALUES (2, 0, true), (3, 0, true), (6, 0, true)) x(size, n_bad, close)")
def activity_driven(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes, times and nodes in range, and about as many edges as the activities make one expect."""
    activities = {k: N.power_law(100, 0.01, 0.5, -2.2, seed=k).tolist() for k in (1, 2, 5)}
    found = cut(N.activity_driven(spark, activities, 100, seed=1))
    bad = (F.col("time") < 0) | (F.col("time") >= 100) | (F.array_max("nodes") >= 100) | (F.size(F.array_distinct("nodes")) != F.col("size"))
    expect = {k + 1: 100 * sum(a) for k, a in activities.items()}
    rows = found.groupBy("size").agg(F.sum("weight").alias("n"), F.sum(bad.cast("int")).alias("n_bad")).collect()  # a row per size
    return spark.createDataFrame([(r["size"], r.n_bad, 0.6 * expect[r["size"]] < r.n < 1.1 * expect[r["size"]]) for r in rows], "size int, n_bad bigint, close boolean")


@query("SELECT 0 AS n_bad, true AS some, true AS again")
def group_attractiveness(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of at least two of the agents at every time of the range, and the same again from the same seed."""
    drawn = [cut(N.group_attractiveness(spark, 60, 40, box=12.0, seed=1)) for _ in range(2)]
    bad = (F.col("size") < 2) | (F.col("time") >= 40) | (F.array_max("nodes") >= 60)
    same = drawn[0].join(drawn[1], ["time", "nodes"], "left_anti").isEmpty()
    return drawn[0].agg(F.sum(bad.cast("int")).cast("bigint").alias("n_bad"), (F.count("*") > 40).alias("some")).withColumn("again", F.lit(same))


@query("SELECT 3 AS n_samples, 0 AS n_bad, true AS together")
def model_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of a block model of two communities: sizes in range, and most edges within one community."""
    import numpy as np

    u = np.array([[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 30) * 0.5
    found = cut(N.sample_mixed_membership(spark, u, np.array([[1.0, 0.01], [0.01, 1.0]]), 4, n_samples=3, burn_in=4000, thinning=0, seed=1))
    bad = (F.size("nodes") < 2) | (F.size("nodes") > 4) | (F.col("weight") < 1)
    within = (F.array_max("nodes") < 30) | (F.array_min("nodes") >= 30)
    return found.agg(F.countDistinct("sample").alias("n_samples"), F.sum(bad.cast("int")).cast("bigint").alias("n_bad"), (F.avg(within.cast("int")) > 0.6).alias("together"))
