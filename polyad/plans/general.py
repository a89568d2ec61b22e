"""Queries of the general data-processing operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.operators.balance import balanced_aggregate, balanced_apply, number_rows
from polyad.operators.references import first_deliveries, life_intervals, orphan_counts, orphan_references
from polyad.plans.registry import Registry
from polyad.plans.tables import table
from polyad.runtime import cut

REGISTRY = Registry()

#: Rows of a chunk of problem 3.
CHUNK = 250_000
FIELDS_SQL = """WITH held AS (
  SELECT 'interaction' AS field, unnest(interaction) AS node, weight, arrived_at FROM hg_edges
  UNION ALL SELECT 'idx', idx, NULL, arrived_at FROM hg_node_records),
known AS (SELECT * FROM held WHERE node IS NOT NULL)"""


def _members(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hg_edges").select(F.explode("interaction").alias("node"), "weight", "arrived_at")
    return rows.where(F.col("node").isNotNull())


def _declared(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hg_node_records").select(F.col("idx").alias("node"), "arrived_at")
    return rows.where(F.col("node").isNotNull())


@REGISTRY.query(FIELDS_SQL + ", total AS (SELECT field, count(*) AS n FROM known GROUP BY field) SELECT k.field, node FROM known k JOIN total t ON t.field = k.field GROUP BY k.field, node, t.n HAVING count(*) * 50 >= t.n")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for field, rows in (("interaction", _members(spark, folder)), ("idx", _declared(spark, folder))):
        counts = balanced_aggregate(rows, "node", {"n": ("count", F.lit(1))}, chunk=CHUNK, columns=[])
        total = rows.agg(F.count("*").alias("total"))
        parts.append(counts.join(F.broadcast(total), F.col("n") * 50 >= F.col("total")).select(F.lit(field).alias("field"), F.col("__key").alias("node")))
    return parts[0].unionByName(parts[1])


@REGISTRY.query(
    FIELDS_SQL
    + " SELECT field, node, count(*) AS n_rows, round(coalesce(sum(weight), 0), 4) AS weight_sum, min(arrived_at) AS first_arrival, max(arrived_at) AS last_arrival FROM known GROUP BY field, node"
)
def p3_nodes(spark: SparkSession, folder: str) -> DataFrame:
    ends = {"n_rows": ("count", F.lit(1)), "first_arrival": ("min", F.col("arrived_at")), "last_arrival": ("max", F.col("arrived_at"))}
    members = balanced_aggregate(_members(spark, folder), "node", ends | {"weight_sum": ("sum", F.col("weight"))}, chunk=CHUNK, columns=["weight", "arrived_at"])
    declared = balanced_aggregate(_declared(spark, folder), "node", ends, chunk=CHUNK, columns=["arrived_at"]).withColumn("weight_sum", F.lit(0.0))
    parts = [x.withColumn("field", F.lit(field)) for field, x in (("interaction", members), ("idx", declared))]
    return parts[0].unionByName(parts[1]).select(
        "field", F.col("__key").alias("node"), "n_rows", F.round(F.coalesce("weight_sum", F.lit(0.0)), 4).alias("weight_sum"), "first_arrival", "last_arrival"
    )


@REGISTRY.query("SELECT idx AS node, count(*) AS n_rows, 0 AS lowest, count(*) - 1 AS highest, count(*) AS n_numbers FROM hg_node_records GROUP BY idx")
def p3_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """The row numbers of each node are exactly 0, 1, ..."""
    rows = number_rows(table(spark, folder, "hg_node_records"), "idx", columns=[])
    return rows.groupBy(F.col("__key").alias("node")).agg(
        F.count("*").alias("n_rows"), F.min("__row").alias("lowest"), F.max("__row").alias("highest"), F.countDistinct("__row").alias("n_numbers")
    )


@REGISTRY.query(
    """WITH held AS (SELECT unnest(interaction) AS node, weight FROM hg_edges)
SELECT node, count(*) AS n_rows, count(weight) AS n_weights, round(avg(weight), 6) AS mean, round(stddev_pop(weight), 6) AS deviation FROM held WHERE node IS NOT NULL GROUP BY node"""
)
def p3_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation of the weights of each node's records: a state per chunk that is no plain sum."""

    def state(rows: pd.DataFrame) -> pd.DataFrame:
        grouped = rows.groupby("__key", dropna=False)["weight"]
        off = (rows["weight"] - grouped.transform("mean")) ** 2
        found = grouped.agg(n_rows="size", n_weights="count", mean="mean")
        return found.assign(spread=off.groupby(rows["__key"], dropna=False).sum()).reset_index()

    def merge(states: pd.DataFrame) -> pd.DataFrame:
        key, n = states["__key"], states["n_weights"].astype(float)
        mean, spread = states["mean"].fillna(0.0), states["spread"].fillna(0.0)
        by_key = lambda x: x.groupby(key, dropna=False)
        whole = by_key(n).transform("sum")
        middle = by_key(n * mean).transform("sum") / whole.where(whole > 0)
        parts = pd.DataFrame({"__key": key, "n_rows": states["n_rows"], "n_weights": states["n_weights"], "mean": n * mean, "variance": spread + n * (mean - middle.fillna(0.0)) ** 2})
        found = parts.groupby("__key", dropna=False).sum().reset_index()
        some = found["n_weights"] > 0
        for c in ("mean", "variance"):
            found[c] = (found[c] / found["n_weights"].where(some).astype(float)).where(some)
        return found

    found = balanced_apply(_members(spark, folder), "node", state, "n_rows long, n_weights long, mean double, spread double", merge, "n_rows long, n_weights long, mean double, variance double", columns=["weight"])
    return found.select(F.col("__key").alias("node"), "n_rows", "n_weights", F.round("mean", 6).alias("mean"), F.round(F.sqrt("variance"), 6).alias("deviation"))


REFERS = (("node", "hif_nodes"), ("edge", "hif_edges"))
ORPHANS_SQL = """WITH placed AS (
  SELECT *, row_number() OVER (PARTITION BY inc_id ORDER BY arrived_at, edge NULLS FIRST, node NULLS FIRST) AS k
  FROM hif_incidences WHERE inc_id IS NOT NULL AND arrived_at IS NOT NULL),
refs AS (
  SELECT 'node' AS field, inc_id, node AS key, arrived_at AS t FROM placed WHERE k = 1 AND node IS NOT NULL
  UNION ALL SELECT 'edge', inc_id, edge, arrived_at FROM placed WHERE k = 1 AND edge IS NOT NULL),
logs AS (
  SELECT 'node' AS field, node AS key, arrived_at AS a, lower(trim(op)) = 'del' AS gone FROM hif_nodes
  UNION ALL SELECT 'edge', edge, arrived_at, lower(trim(op)) = 'del' FROM hif_edges),
latest AS (
  SELECT r.field, r.inc_id, r.t, arg_max(coalesce(l.gone, false), (l.a, coalesce(l.gone, false))) AS gone, count(l.a) AS n
  FROM refs r LEFT JOIN logs l ON l.field = r.field AND l.key = r.key AND l.a <= r.t GROUP BY ALL),
orphans AS (SELECT field, inc_id, t FROM latest WHERE n = 0 OR gone)"""


def _checked(spark: SparkSession, folder: str, check: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``check`` of the references (each incidence once) and the lives of the keys they refer to, for both fields at a time."""
    refs = cut(first_deliveries(table(spark, folder, "hif_incidences"), "inc_id", "arrived_at", ["edge", "node"]))
    found = []
    for field, target in REFERS:
        deleted = F.lower(F.trim("op")) == "del"
        lives = life_intervals(table(spark, folder, target), field, deleted, "arrived_at")
        found.append((field, refs.where(F.col(field).isNotNull()).select("ref", F.col(field).alias("key"), "t"), lives))
    with ThreadPoolExecutor(len(found)) as pool:  # the steps of one field fill the gaps of the other's
        parts = list(pool.map(lambda x: check(x[1], x[2]).withColumn("field", F.lit(x[0])), found))
    return parts[0].unionByName(parts[1])


@REGISTRY.query(ORPHANS_SQL + " SELECT field, inc_id FROM orphans")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder, orphan_references).select("field", F.col("ref").alias("inc_id"))


@REGISTRY.query(ORPHANS_SQL + " SELECT field, strftime(t, '%Y-%m') AS month, count(*) AS n_orphans FROM orphans GROUP BY ALL")
def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder, orphan_counts).select("field", F.date_format("period", "yyyy-MM").alias("month"), "n_orphans")
