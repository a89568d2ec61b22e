"""Tumbling windows and running degrees over streams of edge deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.functions.columns import canonical


def windowed_edges(stream: DataFrame, *, at: str = "arrived_at", members: str = "interaction", width: str = "1 day", late: str = "7 days") -> DataFrame:
    """``start``, ``nodes``, ``n``: how often each edge was delivered in every window.

    Deliveries later than ``late`` behind the newest are dropped by the watermark, and a window is final
    once that has passed; state is one counter per edge and open window.
    """
    rows = stream.withWatermark(at, late).select(F.col(at), canonical(F.col(members)).alias("nodes")).where(F.size("nodes") > 0)
    return rows.groupBy(F.window(at, width).alias("w"), "nodes").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "nodes", "n")


def windowed_degrees(stream: DataFrame, *, key: str = "edge_id", at: str = "arrived_at", members: str = "interaction", width: str = "1 day", late: str = "7 days") -> DataFrame:
    """``start``, ``node``, ``degree``: deliveries per node and window; a key delivered again within the watermark counts once."""
    rows = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    held = rows.select(F.col(at), F.explode(canonical(F.col(members))).alias("node"))
    return held.groupBy(F.window(at, width).alias("w"), "node").agg(F.count("*").alias("degree")).select(F.col("w.start").alias("start"), "node", "degree")


def run_available(result: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; append mode, so only final windows are written."""
    result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
