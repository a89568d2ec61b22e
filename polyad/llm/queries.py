"""The queries of this subpackage over the tables of a data folder, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.llm.cooccur import pairs_together
from polyad.llm.frequent import frequent_items
from polyad.llm.overlap import record_links, record_pairs, similar_between, similar_sets
from polyad.llm.packing import pack_documents, packing_report
from polyad.llm.repetition import fit_kneser_ney, perplexities, perplexity_bands, repeated_letters
from polyad.llm.tokens import encode_corpus
from polyad.operators.records import member_records
from polyad.plans.registry import Registry
from polyad.plans.tables import table
from polyad.runtime import cut

REGISTRY = Registry()

#: One row per record and member, as p1, p2 and p4 count them.
MEMBERS_SQL = """
deliveries AS (SELECT edge_id, unnest(interaction) AS node FROM hg_edges WHERE edge_id IS NOT NULL),
members AS (SELECT DISTINCT edge_id, node FROM deliveries WHERE node IS NOT NULL)"""
PAIRS_SQL = f"""WITH {MEMBERS_SQL},
uses AS (SELECT node, count(*) AS n FROM members GROUP BY node),
total AS (SELECT count(DISTINCT edge_id) AS n FROM members),
pairs AS (
  SELECT a.node AS node_a, b.node AS node_b, count(*) AS n_both
  FROM members a JOIN members b ON a.edge_id = b.edge_id AND a.node < b.node
  GROUP BY 1, 2 HAVING count(*) >= 12)
SELECT node_a, node_b{{columns}}
FROM pairs p JOIN uses ua ON ua.node = p.node_a JOIN uses ub ON ub.node = p.node_b CROSS JOIN total t
WHERE p.n_both * t.n >= 4 * ua.n * ub.n"""


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return member_records(table(spark, folder, "hg_edges"))


def _together(spark: SparkSession, folder: str) -> DataFrame:
    pairs = pairs_together(_records(spark, folder), min_count=12)
    n_both, n_records, n_a, n_b = (F.col(c).cast("decimal(18,0)") for c in ("n_both", "n_records", "n_a", "n_b"))  # products of counts may exceed BIGINT
    above = n_both * n_records >= n_a * n_b * 4
    return pairs.where(above).withColumnsRenamed({"item_a": "node_a", "item_b": "node_b"})


def _frequent(spark: SparkSession, folder: str) -> DataFrame:
    return frequent_items(_records(spark, folder), "members", share="0.01").withColumnRenamed("item", "node")


@REGISTRY.query(PAIRS_SQL.format(columns=""))
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _together(spark, folder).select("node_a", "node_b")


@REGISTRY.query(PAIRS_SQL.format(columns=", n_both, round(p.n_both::DOUBLE * t.n / (ua.n::DOUBLE * ub.n), 6) AS lift"))
def p1_lift(spark: SparkSession, folder: str) -> DataFrame:
    return _together(spark, folder).select("node_a", "node_b", "n_both", F.round("lift", 6).alias("lift"))


SIMILAR_SQL = f"""WITH {MEMBERS_SQL},
sized AS (SELECT edge_id, count(*) AS n FROM members GROUP BY 1 HAVING count(*) >= 6),
held AS (SELECT m.edge_id, m.node, s.n FROM members m JOIN sized s USING (edge_id)),
met AS (
  SELECT a.edge_id AS edge_a, b.edge_id AS edge_b, a.n AS na, b.n AS nb, count(*) AS c
  FROM held a JOIN held b ON a.node = b.node AND a.edge_id < b.edge_id AND 10 * a.n >= 6 * b.n AND 10 * b.n >= 6 * a.n
  GROUP BY ALL)"""


@REGISTRY.query(SIMILAR_SQL + " SELECT edge_a, edge_b FROM met WHERE 10 * c >= 6 * (na + nb - c)")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    classes, pairs = similar_sets(_records(spark, folder), threshold="0.6", least=6)
    return record_pairs(classes, pairs).withColumnsRenamed({"record_a": "edge_a", "record_b": "edge_b"})


@REGISTRY.query(
    SIMILAR_SQL
    + """, pairs AS (SELECT edge_a, edge_b FROM met WHERE 10 * c >= 6 * (na + nb - c)), ends AS (SELECT edge_a AS e FROM pairs UNION ALL SELECT edge_b FROM pairs),
sets AS (SELECT edge_id, list_sort(list(node)) AS s FROM held GROUP BY edge_id)
SELECT edge_id, min(edge_id) OVER (PARTITION BY s) AS class, (SELECT count(*) FROM ends WHERE e = edge_id) AS n_links FROM sets"""
)
def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every record once, with its class and how many records are similar to it."""
    classes, pairs = similar_sets(_records(spark, folder), threshold="0.6", least=6)
    return record_links(classes, pairs).withColumnRenamed("record", "edge_id")


@REGISTRY.query(
    f"""WITH {MEMBERS_SQL}, others AS (SELECT DISTINCT edge, node FROM hif_incidences WHERE edge IS NOT NULL AND node IS NOT NULL),
a AS (SELECT edge_id AS e, node, count(*) OVER (PARTITION BY edge_id) AS n FROM members), b AS (SELECT edge AS e, node, count(*) OVER (PARTITION BY edge) AS n FROM others),
met AS (SELECT a.e AS edge_a, b.e AS edge_b, a.n AS na, b.n AS nb, count(*) AS c FROM a JOIN b ON a.node = b.node AND 10 * a.n >= 6 * b.n AND 10 * b.n >= 6 * a.n WHERE a.n >= 4 AND b.n >= 4 GROUP BY ALL)
SELECT edge_a, edge_b FROM met WHERE 10 * c >= 6 * (na + nb - c)"""
)
def p2_between(spark: SparkSession, folder: str) -> DataFrame:
    """Records of one export that are similar to edges of the other, from 4 members on."""
    rows = table(spark, folder, "hif_incidences").where("edge IS NOT NULL AND node IS NOT NULL")
    others = member_records(rows.groupBy("edge").agg(F.collect_set("node").alias("nodes")), "edge", "nodes")
    found = similar_between(_records(spark, folder), others, threshold="0.6", least=4)
    return found.withColumnsRenamed({"record_a": "edge_a", "record_b": "edge_b"})


@REGISTRY.query(
    f"""WITH {MEMBERS_SQL}, total AS (SELECT count(*) AS n FROM members)
SELECT node FROM members GROUP BY node HAVING count(*) * 100 >= (SELECT n FROM total)"""
)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _frequent(spark, folder).select("node")


@REGISTRY.query(
    f"""WITH {MEMBERS_SQL}, total AS (SELECT count(*) AS n FROM members)
SELECT node, count(*) AS n_records, (SELECT n FROM total) AS n_total, true AS within
FROM members GROUP BY node HAVING count(*) * 100 >= (SELECT n FROM total)"""
)
def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    within = (F.col("estimate") >= F.col("n")) & (F.col("estimate") - F.col("error") <= F.col("n"))
    return _frequent(spark, folder).select("node", F.col("n").alias("n_records"), F.col("total").alias("n_total"), within.alias("within"))


@REGISTRY.query()
def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"), "byte_bpe_50k")


@REGISTRY.query()
def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), table(spark, folder, "container_sizes"))


@REGISTRY.query("SELECT container AS kind, (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM documents) AS n_first_parts, 0 AS n_overfull, 0 AS n_gaps, 0 AS n_needless FROM container_sizes WHERE capacity >= 1 AND tokenizer IS NOT NULL")
def p7_whole(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of a packing: every document is there, no container is overfull, none is missing in the numbers, and only what exceeds the capacity is split."""
    sizes = table(spark, folder, "container_sizes").select(F.col("container").alias("kind"), "capacity")
    placed = cut(pack_documents(table(spark, folder, "documents"), table(spark, folder, "container_sizes"))).join(F.broadcast(sizes), "kind")
    of_documents = placed.groupBy("kind", "capacity", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"), F.sum((F.col("part") == 0).cast("int")).alias("firsts"))
    needless = ((F.col("parts") > 1) & (F.col("n") <= F.col("capacity"))).cast("int")
    of_documents = of_documents.groupBy("kind").agg(F.count("*").alias("n_documents"), F.sum("firsts").alias("n_first_parts"), F.sum(needless).alias("n_needless"))
    bins = placed.where("container IS NOT NULL").groupBy("kind", "capacity", "container").agg(F.sum("n_tokens").alias("n"))
    of_bins = bins.groupBy("kind").agg(F.sum((F.col("n") > F.col("capacity")).cast("int")).alias("n_overfull"), (F.max("container") + 1 - F.count("*")).alias("n_gaps"))
    return of_documents.join(of_bins, "kind").select("kind", "n_documents", "n_first_parts", "n_overfull", "n_gaps", "n_needless")


@REGISTRY.query()
def p7_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return packing_report(table(spark, folder, "documents"), table(spark, folder, "container_sizes"))


SHARES_SQL = """WITH letters AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]', '', 'g') AS t FROM documents),
sized AS (SELECT doc_id, t, length(t) AS n FROM letters),
runs AS (SELECT doc_id, k, substring(t, k::BIGINT, 24) AS run FROM sized, unnest(range(1, greatest(n - 22, 1))) r(k)),
again AS (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS next FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id, run ORDER BY k) AS nth FROM runs) WHERE nth > 1),
covered AS (SELECT doc_id, sum(least(24, coalesce(next - k, 24))) AS n_repeated FROM again GROUP BY doc_id),
shares AS (SELECT s.doc_id, s.n AS n_letters, coalesce(c.n_repeated, 0)::BIGINT AS n_repeated FROM sized s LEFT JOIN covered c USING (doc_id))"""


@REGISTRY.query(SHARES_SQL + " SELECT doc_id FROM shares WHERE n_letters >= 100 AND n_repeated * 10 >= n_letters * 3")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    shares = repeated_letters(table(spark, folder, "documents"), run=24)
    return shares.where((F.col("n_letters") >= 100) & (F.col("n_repeated") * 10 >= F.col("n_letters") * 3)).select("doc_id")


@REGISTRY.query(SHARES_SQL + " SELECT doc_id, n_letters, n_repeated, CASE WHEN n_letters > 0 THEN round(n_repeated / n_letters, 6) ELSE 0.0 END AS share FROM shares")
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    shares = repeated_letters(table(spark, folder, "documents"), run=24)
    share = F.when(F.col("n_letters") > 0, F.col("n_repeated") / F.col("n_letters")).otherwise(F.lit(0.0))
    return shares.select("doc_id", "n_letters", "n_repeated", F.round(share, 6).alias("share"))


@REGISTRY.query()
def p8_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return perplexity_bands(cut(perplexities(documents, fit_kneser_ney(documents))))
