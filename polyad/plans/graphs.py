"""Hypergraphs over the tables of a data folder, and the SQL that makes the same edges.

* records: edge = members of a record of ``hg_edges`` (each ``edge_id`` once), weight = number of records
  with these members;
* parts: edge = parts of an order, weight = number of such orders (``hg_dense`` of suppliers likewise);
* flows: directed, sources = nations of an order's suppliers, target = nation of its customer;
* hours: temporal, edge = users with events of one type in one hour, time = hours since the epoch;
* kinds: edge = event types that a user has on one day, weight = how often; few, whatever the number of events;
* flags: multiplex, layer = return flag, edge = parts of an order with it;
* arcs: directed, source and target nodes of an edge of ``hif_incidences``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.operators.edges import to_undirected, upsert
from polyad.operators.records import member_records
from polyad.plans.tables import table

RECORDS_SQL = """records AS (
  SELECT edge_id AS seq, list_sort(list_distinct(list(n))) AS nodes FROM (SELECT edge_id, unnest(interaction) AS n FROM hg_edges)
  WHERE n IS NOT NULL AND edge_id IS NOT NULL GROUP BY edge_id),
e AS (SELECT nodes, min(seq) AS edge_id, count(*)::DOUBLE AS weight, len(nodes) AS size FROM records GROUP BY nodes),
i AS (SELECT edge_id, size, weight, unnest(nodes) AS node FROM e)"""


def _orders_sql(column: str) -> str:
    return f"""orders_of AS (SELECT l_orderkey AS seq, list_sort(list_distinct(list({column}))) AS nodes FROM lineitem GROUP BY 1),
e AS (SELECT nodes, min(seq) AS edge_id, count(*)::DOUBLE AS weight, len(nodes) AS size FROM orders_of GROUP BY nodes),
i AS (SELECT edge_id, size, weight, unnest(nodes) AS node FROM e)"""


PARTS_SQL = _orders_sql("l_partkey")
SUPPLIERS_SQL = _orders_sql("l_suppkey")
FLOWS_SQL = """legs AS (
  SELECT l_orderkey AS seq, list_sort(list_distinct(list(s_nationkey))) AS src, [any_value(c_nationkey)] AS tgt
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1),
e AS (SELECT src, tgt, min(seq) AS edge_id, count(*)::DOUBLE AS weight, len(src) + len(tgt) AS size, list_sort(list_distinct(list_concat(src, tgt))) AS nodes FROM legs GROUP BY src, tgt)"""
HOURS_SQL = """groups AS (
  SELECT min(event_id) AS seq, (epoch_us(ts) // 3600000000) AS time, event_type, list_sort(list_distinct(list(user_id))) AS nodes FROM events GROUP BY ALL),
e AS (SELECT time, nodes, min(seq) AS edge_id, count(*)::DOUBLE AS weight, len(nodes) AS size FROM groups GROUP BY time, nodes),
i AS (SELECT edge_id, time, size, weight, unnest(nodes) AS node FROM e)""".replace("event_type, list_sort", "event_type AS kind, list_sort")
KINDS_SQL = """daily AS (SELECT min(event_id) AS seq, epoch_us(ts) // 86400000000 AS d, list_sort(list_distinct(list(event_type))) AS nodes FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id, d),
e AS (SELECT nodes, min(seq) AS edge_id, count(*)::DOUBLE AS weight, len(nodes) AS size FROM daily GROUP BY nodes),
i AS (SELECT edge_id, size, weight, unnest(nodes) AS node FROM e)"""
FLAGS_SQL = """groups AS (SELECT l_orderkey AS seq, l_returnflag AS layer, list_sort(list_distinct(list(l_partkey))) AS nodes FROM lineitem GROUP BY 1, 2),
e AS (SELECT layer, nodes, min(seq) AS edge_id, count(*)::DOUBLE AS weight, len(nodes) AS size FROM groups GROUP BY layer, nodes),
i AS (SELECT edge_id, layer, size, weight, unnest(nodes) AS node FROM e)"""


def records(spark: SparkSession, folder: str) -> DataFrame:
    rows = member_records(table(spark, folder, "hg_edges"))
    return upsert(rows.select(F.col("record").alias("seq"), F.col("members").alias("nodes")))


def _of_orders(spark: SparkSession, folder: str, column: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.collect_set(column).alias("nodes"))
    return upsert(rows)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return _of_orders(spark, folder, "l_partkey")


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return _of_orders(spark, folder, "l_suppkey")


def flows(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("s"))
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("t"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customer, "o_custkey")
    sources = lines.join(supplier, "l_suppkey").groupBy("l_orderkey").agg(F.collect_set("s").alias("src"))
    rows = sources.join(orders, "l_orderkey").select(F.col("l_orderkey").alias("seq"), "src", F.array("t").alias("tgt"))
    return upsert(rows, kind="directed")


def hours(spark: SparkSession, folder: str) -> DataFrame:
    hour = F.expr("unix_micros(cast(ts as timestamp)) div 3600000000")
    rows = table(spark, folder, "events").groupBy(hour.alias("time"), "event_type").agg(F.min("event_id").alias("seq"), F.collect_set("user_id").alias("nodes"))
    return upsert(rows, kind="temporal")


def daily_kinds(spark: SparkSession, folder: str) -> DataFrame:
    days = F.expr("unix_micros(cast(ts as timestamp)) div 86400000000")
    rows = table(spark, folder, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL").groupBy("user_id", days.alias("time")).agg(F.min("event_id").alias("seq"), F.collect_set("event_type").alias("nodes"))
    return upsert(rows, kind="temporal")


def kinds(spark: SparkSession, folder: str) -> DataFrame:
    return to_undirected(daily_kinds(spark, folder))


def flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("seq"), F.col("l_returnflag").alias("layer")).agg(F.collect_set("l_partkey").alias("nodes"))
    return upsert(rows, kind="multiplex")
