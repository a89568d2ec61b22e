"""The most frequent items of a column with too many distinct values to count each.

Every partition keeps a space-saving summary of ``counters`` items; summaries are merged in a tree,
whose nodes each hold ``FAN_IN`` summaries at most. A summary's estimate of an item is never below its
count and exceeds it by ``error`` at most. Whatever makes up more than 1 / ``counters`` of all is in the
final summary, so a second pass that counts only the surviving candidates is exact for those.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError

#: Summaries merged by one task, and levels of the tree: the last one merges the rest, one summary per 4,096 partitions at 16 and 4.
FAN_IN = 16
LEVELS = 4
SUMMARY = "item bigint, estimate bigint, error bigint, floor bigint, total bigint, part bigint"


def merge_summaries(items: np.ndarray, estimates: np.ndarray, errors: np.ndarray, floors: np.ndarray, sources: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Merge summaries (rows of several ``sources``; ``floors[s]`` is what an item missing in source s may have had).

    An item that a source lacks takes that source's floor as estimate and error. The largest
    ``counters`` estimates stay; the floor of the result is the largest that left, or the sum of the
    floors if none did.
    """
    base = int(floors.sum())
    keys, where = np.unique(items, return_inverse=True)
    estimate = np.full(len(keys), base, np.int64)
    error = np.full(len(keys), base, np.int64)
    np.add.at(estimate, where, estimates - floors[sources])
    np.add.at(error, where, errors - floors[sources])
    if len(keys) <= counters:
        return keys, estimate, error, base
    order = np.lexsort((keys, -estimate))
    stay = order[:counters]
    return keys[stay], estimate[stay], error[stay], int(estimate[order[counters]])


def _summary_frame(state: tuple[np.ndarray, np.ndarray, np.ndarray, int], total: int, part: int) -> pd.DataFrame:
    """The summary's rows; if it has none, a row with a null item still carries the totals."""
    items, estimates, errors, floor = state
    frame = pd.DataFrame({"item": pd.array(items, dtype="Int64"), "estimate": estimates, "error": errors})
    if not len(frame):
        frame = pd.DataFrame({"item": pd.array([None], dtype="Int64"), "estimate": [0], "error": [0]})
    return frame.assign(floor=floor, total=total, part=part)


def _partition_summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = (np.zeros(0, np.int64),) * 3 + (0,)
        total = 0
        for batch in batches:
            column = batch.column(0)
            items, counts = np.unique(np.asarray(column.flatten()), return_counts=True)
            total += int(counts.sum())
            nothing = np.zeros(len(items), np.int64)
            state = merge_summaries(
                np.concatenate([state[0], items]),
                np.concatenate([state[1], counts]),
                np.concatenate([state[2], nothing]),
                np.array([state[3], 0]),
                np.repeat([0, 1], [len(state[0]), len(items)]),
                counters,
            )
        frame = _summary_frame(state, total, TaskContext.get().partitionId())
        yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return run


def _merge_parts(counters: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts, sources = np.unique(frame["part"].to_numpy(), return_inverse=True)
        firsts = np.unique(sources, return_index=True)[1]
        floors, totals = frame["floor"].to_numpy()[firsts], frame["total"].to_numpy()[firsts]
        real = frame["item"].notna().to_numpy()
        state = merge_summaries(
            frame["item"][real].to_numpy(dtype=np.int64), frame["estimate"].to_numpy()[real], frame["error"].to_numpy()[real], floors, sources[real], counters
        )
        return _summary_frame(state, int(totals.sum()), int(parts[0]) // FAN_IN)

    return run


def summarize_items(lists: DataFrame, column: str, *, counters: int = 1024) -> DataFrame:
    """The merged summary: ``item``, ``estimate``, ``error``, ``floor`` and ``total``.

    ``column`` is an ARRAY<BIGINT>; null elements and null arrays count nothing. At most ``counters``
    rows; without any element, none. An item that is not listed occurs ``floor`` times at most.
    """
    if counters < 1:
        raise InvalidParameterError("counters must be at least 1")
    source = lists.select(F.array_compact(F.coalesce(F.col(column).cast("array<bigint>"), F.array().cast("array<bigint>"))).alias("items"))
    summaries = source.mapInArrow(_partition_summaries(counters), SUMMARY)
    for level in range(LEVELS):
        group = F.expr(f"part div {FAN_IN}") if level < LEVELS - 1 else F.lit(0)
        summaries = summaries.groupBy(group.alias("group")).applyInPandas(_merge_parts(counters), SUMMARY)
    return summaries.where(F.col("item").isNotNull()).drop("part")


def frequent_items(lists: DataFrame, column: str, *, share: float | str, counters: int | None = None) -> DataFrame:
    """``item``, ``n`` (exact), ``estimate``, ``error`` and ``total`` of the items that make up at least ``share`` of all elements.

    Repeated elements of an array count each time; ``share`` is read as a decimal, and equality counts. ``counters`` defaults to 8 / share, which keeps the
    candidates few; they are the only rows broadcast (``counters`` at most, whatever the data).
    """
    least = Fraction(str(share))
    if not 0 < least <= 1:
        raise InvalidParameterError("share must lie in (0, 1]")
    counters = counters or int(8 / least)
    if counters * least < 1:
        raise InvalidParameterError("counters must be at least 1 / share, else a frequent item could be missed")
    summary = summarize_items(lists, column, counters=counters)

    def reached(count: str) -> Column:
        return F.col(count) * F.lit(least.denominator) >= F.col("total") * F.lit(least.numerator)

    candidates = summary.where(reached("estimate"))
    rows = lists.select(F.explode(F.col(column).cast("array<bigint>")).alias("item"))
    counted = rows.join(F.broadcast(candidates.select("item")), "item", "left_semi").groupBy("item").agg(F.count("*").alias("n"))
    found = counted.join(F.broadcast(candidates), "item")
    return found.where(reached("n")).select("item", "n", "estimate", "error", "total")
