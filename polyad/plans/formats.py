"""Queries of files: what is written in each format and read back is the same hypergraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad import Hypergraph
from polyad.operators import edges as E
from polyad.plans import graphs as G
from polyad.plans.registry import Registry
from polyad.plans.structure import SHOWN_SQL, shown
from polyad.plans.tables import table
from polyad.runtime import cut, new_folder
from polyad.sources import files

REGISTRY = Registry()
query = REGISTRY.query


def graph_of(edges: DataFrame, nodes: DataFrame | None = None) -> Hypergraph:
    """The object of an edge table, with the nodes' metadata if ``nodes`` has them."""
    known = E.node_table(edges, nodes)
    known = known.join(nodes.select("node", "meta"), "node", "left") if nodes is not None and "meta" in nodes.columns else known.withColumn("meta", F.lit(None).cast("map<string,string>"))
    return Hypergraph(edges, known, E.kind_of(edges))


def _again(graph: Hypergraph, fmt: str, **options) -> Hypergraph:
    """Written to the shared folder in a format, and read from there."""
    path = f"{new_folder(graph.edges.sparkSession)}.{fmt}"
    files.write_hypergraph(graph.stored(), path, fmt=fmt, **options)
    return Hypergraph.read(graph.edges.sparkSession, path, fmt=fmt)


@query(f"WITH {G.RECORDS_SQL} SELECT {SHOWN_SQL} FROM e")
def file_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_again(graph_of(G.records(spark, folder)), "parquet").edges)


@query(f"WITH {G.RECORDS_SQL} SELECT {SHOWN_SQL} FROM e")
def file_json(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_again(graph_of(G.records(spark, folder)), "json").edges)


@query(f"WITH {G.FLOWS_SQL} SELECT array_to_string(src, '|') AS src, array_to_string(tgt, '|') AS tgt, size, weight FROM e")
def file_json_directed(spark: SparkSession, folder: str) -> DataFrame:
    found = _again(graph_of(G.flows(spark, folder)), "json", array=True).edges
    return found.select(*[F.array_join(F.col(c).cast("array<string>"), "|").alias(c) for c in ("src", "tgt")], "size", "weight")


@query(f"WITH {G.HOURS_SQL} SELECT time, {SHOWN_SQL} FROM e")
def file_json_temporal(spark: SparkSession, folder: str) -> DataFrame:
    """One array in one file."""
    return shown(_again(graph_of(G.hours(spark, folder)), "json", array=True).edges, "time")


@query(f"WITH {G.FLAGS_SQL} SELECT layer, {SHOWN_SQL} FROM e")
def file_json_multiplex(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_again(graph_of(G.flags(spark, folder)), "json").edges, "layer")


@query(
    """WITH named AS (SELECT DISTINCT idx AS node, x.key AS name, x.value AS value FROM (SELECT idx, unnest(map_entries(meta)) AS x FROM hg_node_records WHERE idx IS NOT NULL) WHERE x.value IS NOT NULL)
SELECT node, name, max(value) AS value FROM named GROUP BY ALL"""
)
def file_json_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of nodes, of contradicting values the largest, through JSON."""
    rows = table(spark, folder, "hg_node_records").where("idx IS NOT NULL").select(F.col("idx").alias("node"), "meta")
    nodes = E.merged_meta(rows, ["node"]).select("node", F.transform_values("meta", lambda k, v: F.array_max(v)).alias("meta"))
    found = _again(graph_of(G.records(spark, folder), nodes), "json").nodes
    return found.select("node", F.explode("meta").alias("name", "value"))


@query(f"WITH {G.PARTS_SQL} SELECT {SHOWN_SQL} FROM e")
def file_hgr(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_again(graph_of(G.parts(spark, folder)), "hgr").edges)


@query(f"WITH {G.PARTS_SQL} SELECT size, array_to_string(list_sort(list_transform(nodes, lambda x: x::VARCHAR)), '|') AS nodes FROM e")
def file_hif(spark: SparkSession, folder: str) -> DataFrame:
    """A HIF document names nodes by text."""
    return _again(graph_of(G.parts(spark, folder)), "hif").edges.select("size", F.array_join("nodes", "|").alias("nodes"))


@query(f"WITH {G.FLOWS_SQL} SELECT array_to_string(list_sort(list_transform(src, lambda x: x::VARCHAR)), '|') AS src, array_to_string(list_sort(list_transform(tgt, lambda x: x::VARCHAR)), '|') AS tgt FROM e")
def file_hif_directed(spark: SparkSession, folder: str) -> DataFrame:
    return _again(graph_of(G.flows(spark, folder)), "hif").edges.select(F.array_join("src", "|").alias("src"), F.array_join("tgt", "|").alias("tgt"))


@query(
    """WITH known AS (SELECT DISTINCT edge, node FROM hif_incidences WHERE edge IS NOT NULL AND node IS NOT NULL),
m AS (SELECT edge, count(*) AS n FROM known GROUP BY edge)
SELECT 'edges' AS part, count(*) AS n, sum(n)::BIGINT AS total FROM m
UNION ALL SELECT 'empty', count(DISTINCT edge), 0 FROM hif_edges WHERE edge IS NOT NULL AND edge NOT IN (SELECT edge FROM m)
UNION ALL SELECT 'nodes', count(DISTINCT node), 0 FROM (SELECT node FROM known UNION SELECT node FROM hif_nodes WHERE node IS NOT NULL)"""
)
def file_hif_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The incidences of the export as they were delivered, with its empty edges and lone nodes."""
    members, empty, nodes = files.incidence_edges(table(spark, folder, "hif_incidences").select("edge", "node"), table(spark, folder, "hif_edges").select("edge"), table(spark, folder, "hif_nodes").select("node"))
    parts = [
        members.agg(F.lit("edges").alias("part"), F.count("*").alias("n"), F.sum(F.size("nodes")).alias("total")),
        empty.agg(F.lit("empty").alias("part"), F.count("*").alias("n"), F.lit(0).cast("bigint").alias("total")),
        nodes.agg(F.lit("nodes").alias("part"), F.count("*").alias("n"), F.lit(0).cast("bigint").alias("total")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LANES = ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT)::VARCHAR AS s{k}" for k in range(8))
SUMS = ", ".join(f"s{k}" for k in range(8))


@query(
    f"""WITH {G.RECORDS_SQL}, rows AS (
  SELECT sha256('e' || chr(31) || '{{"nodes":[' || array_to_string(nodes, ',') || ']}}' || chr(31) || format('{{:.9e}}', weight) || chr(31)) AS h FROM e
  UNION ALL SELECT DISTINCT sha256('n' || chr(31) || node::VARCHAR || chr(31)) FROM i),
lanes AS (SELECT {LANES} FROM rows)
SELECT sha256(concat_ws(':', 'undirected true', {SUMS})) AS hash, true AS same_from_file, false AS same_without_an_edge FROM lanes"""
)
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of the content, that of the same content from a file, and that of a little less."""
    graph = graph_of(cut(G.records(spark, folder)))
    whole = graph.hash()
    less = graph.edges.agg(F.min("edge_id")).first()[0]
    other = Hypergraph(graph.edges.where(F.col("edge_id") != less), graph.nodes)
    return spark.createDataFrame([(whole, _again(graph, "parquet").hash() == whole, other.hash() == whole)], "hash string, same_from_file boolean, same_without_an_edge boolean")


@query(f"WITH {G.PARTS_SQL} SELECT count(*) AS n_edges, sum(size)::BIGINT AS total FROM e")
def file_remote(spark: SparkSession, folder: str) -> DataFrame:
    """A data set found by its name alone."""
    base = new_folder(spark)
    files.write_hypergraph(graph_of(G.parts(spark, folder)).stored(), f"{base}/parts.hgr", fmt="hgr")
    return files.read_remote(spark, "parts", base=base, allow_network=True).edges.agg(F.count("*").alias("n_edges"), F.sum("size").alias("total"))
