"""Items that appear together in records: counts of pairs, and how far above chance they are.

Heavy-light decomposition. An item is heavy if it holds at least ``heavy_share`` of all memberships, so
there are at most ``1 / heavy_share`` heavy items whatever the data, and they alone are ever broadcast.

* heavy with heavy: each block of records is a dense bit matrix, one row of bits per heavy item; the
  counts are popcounts of the rows' conjunctions;
* heavy with light: the list of records of each light item in the block probes the heavy items' bits;
* light with light: pairs are hashed and counted, combined before the shuffle.

Items below ``min_count`` can't be in a pair that reaches it and leave before any pair is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.runtime import bounded_rows, cut

#: Records of a block; bounds the bit matrix to heavy items x BLOCK / 8 bytes.
BLOCK = 32_768
#: Light items' memberships that probe at once, and pairs of a wide record made at once.
PROBES = 8_192
#: Light members of a record are cut into blocks of this many; a record's pairs are made by pairs of blocks.
WIDE = 256


def _bit_rows(rows: np.ndarray, items: np.ndarray, n_rows: int, n_items: int) -> np.ndarray:
    """Bits of item by record: ``[n_items, ceil(n_rows / 8)]``."""
    bits = np.zeros((n_items, (n_rows + 7) // 8 * 8), dtype=bool)
    bits[items, rows] = True
    return np.packbits(bits, axis=1)


def _heavy_pairs(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Popcounts of all conjunctions of two rows that are not 0."""
    pad = (-bits.shape[1]) % 8
    words = np.pad(bits, ((0, 0), (0, pad))).view(np.uint64)
    firsts, seconds, counts = [], [], []
    for a in range(len(words) - 1):
        found = np.bitwise_count(words[a + 1 :] & words[a]).sum(axis=1, dtype=np.int64)
        at = np.flatnonzero(found)
        firsts.append(np.full(len(at), a))
        seconds.append(at + a + 1)
        counts.append(found[at])
    if not firsts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(firsts), np.concatenate(seconds), np.concatenate(counts)


def _probe(light: np.ndarray, light_rows: np.ndarray, by_row: np.ndarray, n_heavy: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(light item, heavy index, count), from the lists of records of the light items probing bits ``by_row``."""
    order = np.argsort(light, kind="stable")
    light, light_rows = light[order], light_rows[order]
    for start in range(0, len(light), PROBES):
        items, rows = light[start : start + PROBES], light_rows[start : start + PROBES]
        hits = np.unpackbits(by_row[rows], axis=1, count=n_heavy)
        begins = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
        counts = np.add.reduceat(hits, begins, axis=0, dtype=np.int64)
        at, heavy = np.nonzero(counts)
        yield items[begins[at]], heavy, counts[at, heavy]


def _dense_pairs(heavy: np.ndarray):
    """Counts of the pairs with a heavy item, by blocks of records of bounded size."""
    heavy = np.sort(heavy)

    def block(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sizes = np.concatenate([p[0] for p in parts])
        items = np.concatenate([p[1] for p in parts])
        rows = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(heavy, items), len(heavy) - 1)
        is_heavy = heavy[at] == items
        bits = _bit_rows(rows[is_heavy], at[is_heavy], len(sizes), len(heavy))
        a, b, n = _heavy_pairs(bits)
        yield _batch(heavy[a], heavy[b], n)
        by_row = np.packbits(np.unpackbits(bits, axis=1, count=len(sizes)).T, axis=1)
        for light, h, n in _probe(items[~is_heavy], rows[~is_heavy], by_row, len(heavy)):
            yield _batch(np.minimum(light, heavy[h]), np.maximum(light, heavy[h]), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, room = [], 0
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                lists = batch.column(0).slice(start, BLOCK)
                parts.append((np.asarray(lists.value_lengths()), np.asarray(lists.flatten())))
                room += len(lists)
                if room >= BLOCK:
                    yield from block(parts)
                    parts, room = [], 0
        if parts:
            yield from block(parts)

    return run


def _batch(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])


def item_counts(records: DataFrame) -> DataFrame:
    """``item`` and ``n_item``, the number of records that hold it."""
    return records.select(F.explode("members").alias("item")).groupBy("item").agg(F.count("*").alias("n_item"))


def pairs_together(records: DataFrame, *, min_count: int = 1, heavy_share: float = 1 / 512) -> DataFrame:
    """Pairs of items in the same record, with counts and lift.

    ``records`` has one row per ``record`` with the array ``members`` of distinct non-null items (as
    ``member_records`` makes it; other columns are dropped). Result: ``item_a`` < ``item_b``, ``n_both``, ``n_a``, ``n_b``,
    ``n_records`` and ``lift`` = n_both * n_records / (n_a * n_b), for pairs with ``n_both`` >=
    ``min_count``. Every pair is counted exactly. Records without members count neither as records
    nor in pairs; an empty table gives an empty result.
    """
    if not 0 < heavy_share <= 1 or min_count < 1:
        raise InvalidParameterError("heavy_share must lie in (0, 1], min_count must be at least 1")
    records = cut(records.select("record", "members").where(F.size("members") > 0))
    counts = cut(item_counts(records).where(F.col("n_item") >= min_count))
    n_records = records.count()
    memberships = records.agg(F.sum(F.size("members"))).first()[0] or 0
    most = int(1 / heavy_share)
    heavy = {r.item: r.n_item for r in bounded_rows(counts.where(F.col("n_item") >= F.lit(max(1.0, memberships * heavy_share))), most, "heavy items")}
    if min_count > 1:
        records = _without_rare(records, counts, list(heavy))
    found = _light_pairs(records, list(heavy))
    if heavy:
        found = found.unionByName(records.select("members").mapInArrow(_dense_pairs(np.array(list(heavy), dtype=np.int64)), "a bigint, b bigint, n bigint"))
    scored = found.groupBy("a", "b").agg(F.sum("n").alias("n_both")).where(F.col("n_both") >= min_count)
    for side, other in ("ab", "ba"):
        scored = _with_count(scored, side, other, counts, heavy)
    lift = F.col("n_both").cast("double") * F.lit(n_records) / (F.col("n_a").cast("double") * F.col("n_b"))
    return scored.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_both", "n_a", "n_b", F.lit(n_records).cast("bigint").alias("n_records"), lift.alias("lift"))


def _light_pairs(records: DataFrame, heavy: list[int]) -> DataFrame:
    """``a`` < ``b``, ``n`` = 1 for every record's pairs of light items.

    A record's light items are cut into blocks, and every two of its blocks (or one with itself) make the
    pairs between them. Most records are one block and stay where they are; of the others every pair of blocks goes
    to a task of its own, with two blocks of items whatever the record's length.
    """
    heavy_array = F.array(*[F.lit(x) for x in heavy]).cast("array<bigint>")
    light = records.select(F.array_sort(F.array_except("members", heavy_array)).alias("light")).where(F.size("light") > 1)
    one = light.where(F.size("light") <= WIDE).select(F.col("light").alias("x"), F.col("light").alias("y"), F.lit(True).alias("same"))
    blocks = F.expr(f"transform(sequence(0, (size(light) - 1) div {WIDE}), k -> slice(light, k * {WIDE} + 1, {WIDE}))")
    many = light.where(F.size("light") > WIDE).select(F.monotonically_increasing_id().alias("of"), F.posexplode(blocks).alias("i", "x"), "light")
    # the second block is cut from the rest of the record only after the first has been chosen
    many = many.select("of", "i", "x", F.posexplode(F.expr(f"transform(sequence(i, (size(light) - 1) div {WIDE}), k -> slice(light, k * {WIDE} + 1, {WIDE}))")).alias("j", "y"))
    many = many.repartition("of", "i", "j").select("x", "y", (F.col("j") == 0).alias("same"))
    both = one.unionByName(many).select(F.posexplode("x").alias("k", "a"), "y", "same")
    later = F.when(F.col("same"), F.expr("slice(y, k + 2, size(y))")).otherwise(F.col("y"))
    return both.select("a", F.explode(later).alias("b"), F.lit(1).cast("bigint").alias("n"))


def _with_count(pairs: DataFrame, side: str, other: str, counts: DataFrame, heavy: dict[int, int]) -> DataFrame:
    """``pairs`` with ``n_`` of one side: of heavy items from a table of at most 1 / share rows, of light ones by a join.

    In the join the pairs of a heavy item, which may be very many, are spread by their other item and meet nothing.
    """
    spark = pairs.sparkSession
    known = spark.createDataFrame(list(heavy.items()), f"{side} bigint, known bigint")
    pairs = pairs.join(F.broadcast(known), side, "left").withColumn("light", F.col("known").isNull()).withColumn("by", F.coalesce(F.when(F.col("light"), F.col(side)), F.col(other)))
    light = counts.join(F.broadcast(known.select(F.col(side).alias("item"))), "item", "left_anti").select(F.lit(True).alias("light"), F.col("item").alias("by"), F.col("n_item").alias("found"))
    joined = pairs.join(light, ["light", "by"], "left")
    return joined.withColumn(f"n_{side}", F.coalesce("known", "found")).drop("light", "by", "known", "found")


def _without_rare(records: DataFrame, counts: DataFrame, heavy: list[int]) -> DataFrame:
    """Records with only the items of ``counts``. Heavy items stay in place; the others, none of them hot, are joined."""
    heavy_array = F.array(*[F.lit(x) for x in heavy]).cast("array<bigint>")
    light = records.select("record", F.explode(F.array_except("members", heavy_array)).alias("item"))
    kept = light.join(counts.select("item"), "item", "left_semi").select("record", "item")
    dense = records.select("record", F.explode(F.array_intersect("members", heavy_array)).alias("item"))
    return kept.unionByName(dense).groupBy("record").agg(F.collect_list("item").alias("members")).where(F.size("members") > 1).select("members")
