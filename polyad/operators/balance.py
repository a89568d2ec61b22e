"""Per-key results where a few keys hold most rows: exact offset chunking.

Keys are counted per input partition; prefix sums of the counts give every (key, partition) the exact
place where its rows begin in one global order of keys. Rows are then numbered without any group larger
than one input partition, and the numbers are cut into chunks of equal size. A chunk is one unit of work
whatever its keys are: its rows come together in one task. A key inside one chunk is done there; one that
crosses chunks leaves one state in each, and these few states are merged in their order.

The counts and the numbering read the input once each. An input that is no plain read of tables (scan,
projection, filter, generator, union) might give its rows in other partitions the second time, so it is
written to the shared folder first. The numbering also checks every (key, partition) against its count
and fails where they differ, so rows are never lost or numbered twice without an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from polyad.errors import InvalidParameterError
from polyad.runtime import cut

#: Buckets of keys in the prefix sum; each holds few of the per-key counts, none of the rows.
BUCKETS = 1024
ROW, PART, PLACE, NUMBER, CHUNK = "__row", "__part", "__place", "__number", "__chunk"
#: Bits of a row's place that are its number within its partition.
PLACE_BITS = 33
#: Operators that give the same rows in the same partitions whenever a table is read again.
STEADY = {"Project", "Filter", "Generate", "Union", "LogicalRelation"}


def reads_alike(df: DataFrame) -> bool:
    """Whether reading ``df`` again gives the same rows in the same partitions: it only reads tables, row by row."""

    def steady(plan) -> bool:
        children = plan.children().iterator()
        below = []
        while children.hasNext():
            below.append(steady(children.next()))
        return plan.nodeName() in STEADY and plan.deterministic() and all(below)

    return steady(df._jdf.queryExecution().optimizedPlan())


def key_offsets(placed: DataFrame, key: str) -> DataFrame:
    """``key``, ``PART``, ``n``, ``in_key`` and ``start``: where the rows of a key in a partition begin, within the key and over all.

    ``placed`` has the column ``PART``. The prefix sums run over counts: by partition within a key, by
    key within a bucket, and over the buckets. The key stands in a struct, which is never null itself, so
    that all steps share one partitioning and a null key is a key.
    """
    counts = placed.groupBy(F.struct(F.col(key).alias("k")).alias("held"), PART).agg(F.count("*").alias("n"))
    by_part = Window.partitionBy("held").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("in_key", F.coalesce(F.sum("n").over(by_part), F.lit(0)))
    keys = counts.groupBy("held").agg(F.sum("n").alias("of_key")).withColumn("bucket", F.pmod(F.hash("held"), F.lit(BUCKETS)))
    buckets = keys.groupBy("bucket").agg(F.sum("of_key").alias("of_bucket"))
    in_order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    buckets = buckets.select("bucket", F.coalesce(F.sum("of_bucket").over(in_order), F.lit(0)).alias("before"))
    by_key = Window.partitionBy("bucket").orderBy("held").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.withColumn("in_bucket", F.coalesce(F.sum("of_key").over(by_key), F.lit(0))).join(F.broadcast(buckets), "bucket")
    starts = starts.select("held", (F.col("before") + F.col("in_bucket")).alias("key_start"))
    return counts.join(starts, "held").select(F.col("held.k").alias(key), PART, "n", "in_key", (F.col("key_start") + F.col("in_key")).alias("start"))


def number_rows(df: DataFrame, key: Column | str, *, columns: list[str] | None = None) -> DataFrame:
    """Rows with ``__key``, ``__row`` (0, 1, ... within the key) and ``__number`` (0, 1, ... over all), in stored order within a key.

    A null key is a key. Equal rows get numbers of their own. The rows of a key in one input partition
    are the largest group that is ever sorted together; they are shuffled once, and meet the offset of
    their group as its first row instead of by a join. ``columns`` limits what is carried along.
    """
    clash = {"__key", ROW, PART, PLACE, NUMBER, "__n", "__in_key", "__start"} & set(df.columns)
    if clash:
        raise InvalidParameterError(f"columns of these names can't be numbered: {sorted(clash)}")
    key = F.col(key) if isinstance(key, str) else key
    kept = df.columns if columns is None else columns
    chosen = df.select(*kept, key.alias("__key"))
    alike = reads_alike(chosen)
    placed = chosen.withColumn(PLACE, F.monotonically_increasing_id())
    placed = (placed if alike else cut(placed)).withColumn(PART, F.shiftright(PLACE, PLACE_BITS))
    offsets = key_offsets(placed.select("__key", PART), "__key").select("__key", PART, F.col("n").alias("__n"), F.col("in_key").alias("__in_key"), F.col("start").alias("__start"))
    heads = offsets.select(*[F.lit(None).cast(chosen.schema[c].dataType).alias(c) for c in kept], "__key", F.lit(-1).cast("bigint").alias(PLACE), PART, "__n", "__in_key", "__start")
    rows = placed.withColumns({c: F.lit(None).cast("bigint") for c in ("__n", "__in_key", "__start")}).select(heads.columns)
    group = Window.partitionBy("__key", PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = lambda c: F.first(c).over(group)
    ranked = rows.unionByName(heads).withColumns({"__k": F.row_number().over(group) - 2, "__most": first("__n"), "__within": first("__in_key"), "__from": first("__start")})
    sound = F.col("__most").isNotNull() & (F.col("__k") < F.col("__most"))
    at = lambda c: F.when(sound, F.col(c) + F.col("__k")).otherwise(F.raise_error(F.lit("the input gave other rows or partitions when it was read again")).cast("bigint"))
    return ranked.where(F.col(PLACE) >= 0).select(*kept, "__key", at("__within").alias(ROW), at("__from").alias(NUMBER))


def chunk_rows(df: DataFrame, key: Column | str, *, chunk: int, columns: list[str] | None = None) -> DataFrame:
    """As ``number_rows``, with ``__chunk``: each has exactly ``chunk`` rows but the last, and lies in one partition as a whole."""
    if chunk < 1:
        raise InvalidParameterError("chunk must be at least 1")
    return number_rows(df, key, columns=columns).withColumn(CHUNK, F.expr(f"{NUMBER} div {chunk}")).repartition(CHUNK)


def balanced_aggregate(df: DataFrame, key: Column | str, states: dict[str, tuple[str, Column]], *, chunk: int = 1_000_000, columns: list[str] | None = None) -> DataFrame:
    """``__key`` and one column per entry of ``states``: name to (how, expression).

    How is one of count, sum, min, max, first, last; first and last are by stored order and may be null.
    Every chunk aggregates its own rows where they lie; the states of keys that cross chunks are merged in
    order. Only the columns that the expressions need should be carried along (``columns``).
    Sums of DOUBLE may differ in their last digits with the order of addition.
    """
    merges = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    firsts = {"first": F.min_by, "last": F.max_by}
    if bad := {how for how, _ in states.values()} - set(merges) - set(firsts):
        raise InvalidParameterError(f"unknown aggregates: {sorted(bad)}")
    rows = chunk_rows(df, key, chunk=chunk, columns=columns)
    own = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    parts = [(own[how](x) if how in own else firsts[how](x, F.col(NUMBER))).alias(name) for name, (how, x) in states.items()]
    by_chunk = rows.groupBy("__key", CHUNK).agg(*parts)
    merged = [(merges[how](name) if how in merges else firsts[how](name, F.col(CHUNK))).alias(name) for name, (how, _) in states.items()]
    return by_chunk.groupBy("__key").agg(*merged)


def _frame(table: pa.Table) -> pd.DataFrame:
    """Whole numbers stay whole where some are null."""
    return table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)


def balanced_apply(
    df: DataFrame,
    key: Column | str,
    process: Callable[[pd.DataFrame], pd.DataFrame],
    state: T.StructType | str,
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    result: T.StructType | str,
    *,
    chunk: int = 100_000,
    columns: list[str] | None = None,
) -> DataFrame:
    """Any ordered computation per key. ``process`` gets the rows of one chunk, keys together and each key's rows in
    order, and gives one state per ``__key``; ``merge`` gets the states of some keys, those of a key together and in
    order, and gives one result per ``__key``.

    Both schemas leave out the key, which is added as ``__key``. No task gets more than ``chunk`` rows at
    once, and of a key's states as many as the chunks it crosses. Both functions may work on all keys at a
    time; a null key is a key (group with ``dropna=False``).
    """
    rows = chunk_rows(df, key, chunk=chunk, columns=columns)
    kind = rows.schema["__key"].dataType
    fields = [T._parse_datatype_string(s) if isinstance(s, str) else s for s in (state, result)]
    states = T.StructType([T.StructField("__key", kind), T.StructField(CHUNK, T.LongType()), *fields[0].fields])
    results = T.StructType([T.StructField("__key", kind), *fields[1].fields])
    arrow = [to_arrow_schema(x) for x in (states, results)]

    def of_chunk(table: pa.Table) -> pa.Table:
        frame = _frame(table).sort_values(NUMBER, kind="stable")
        found = process(frame).assign(**{CHUNK: frame[CHUNK].iloc[0]})
        return pa.Table.from_pandas(found[states.names], schema=arrow[0], preserve_index=False)

    def result_of(frame: pd.DataFrame) -> list[pa.RecordBatch]:
        return pa.Table.from_pandas(merge(frame)[results.names], schema=arrow[1], preserve_index=False).to_batches()

    def of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = _frame(pa.Table.from_batches([batch]))
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            keys = pd.factorize(frame["__key"], use_na_sentinel=False)[0]
            whole = int((keys == keys[-1]).argmax())  # the last key may go on in the next batch
            held = frame.iloc[whole:]
            if whole:
                yield from result_of(frame.iloc[:whole])
        if held is not None:
            yield from result_of(held)

    merged = rows.groupBy(CHUNK).applyInArrow(of_chunk, states)
    return merged.repartition("__key").sortWithinPartitions("__key", CHUNK).mapInArrow(of_keys, results)
