"""Records with a set of members, from deliveries as they were stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def member_set(members: Column) -> Column:
    """The distinct non-null elements in ascending order; empty for a null array."""
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(members))), F.array().cast("array<bigint>"))


def member_records(df: DataFrame, key: str = "edge_id", members: str = "interaction") -> DataFrame:
    """``record`` and ``members``: one row per key that has members, with the distinct non-null ones sorted.

    However often a key was delivered, it counts once; if its deliveries differ, its members are their
    union. Null keys are no records. Deliveries are made equal before the shuffle, so that a key with
    very many of them is reduced where it is read. Other columns are dropped.
    """
    rows = df.select(F.col(key).alias("record"), member_set(F.col(members).cast("array<bigint>")).alias("members"))
    rows = rows.where(F.col("record").isNotNull() & (F.size("members") > 0))
    sets = rows.groupBy("record").agg(F.collect_set("members").alias("sets"))
    only = F.when(F.size("sets") == 1, F.col("sets")[0]).otherwise(F.array_sort(F.array_distinct(F.flatten("sets"))))
    return sets.select("record", only.alias("members"))
