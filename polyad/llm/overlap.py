"""All pairs of set-valued records whose Jaccard similarity reaches a threshold.

Size-aware overlap join. Two sets of sizes r and s reach similarity t exactly if they share
c(r, s) = ceil(t / (1 + t) * (r + s)) values.

* Small sets (size up to ``small``): each enumerates its subsets of every size c that a small partner
  could require. Two small sets are similar exactly if they share such a subset, so a subset's group
  holds nothing but results.
* Large sets: the inverted lists of values are scanned for every pair with a large set. Two sets that
  share c values share one of their rarest size - c + 1, so a set is only in the lists of these. The list
  of a common value is parted by a second value, for they share two of their rarest size - c + 2: such a
  list is never read as a whole.

Both kinds of candidates are united, made distinct and verified on the sets themselves. Equal sets are
one class, joined once. What a task builds at once is bounded by ``ROOM`` keys, whatever a set's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.runtime import cut

#: Counters that estimate how common a value is; their number is fixed, so they may be broadcast.
BUCKETS = 1 << 18
SHIFT = np.uint64(64 - 18)
#: A value that the counters give more sets than this is common: its inverted list is parted by a second value.
COMMON = 8
#: Keys made at once: bounds the memory of a batch.
ROOM = 2_000_000
#: Records of a class that one task joins at once.
CLASS_BLOCK = 4_096


def needed(r: int, s: int, threshold: Fraction) -> int:
    """Common values that sets of sizes r and s need."""
    return math.ceil(threshold * (r + s) / (1 + threshold))


def _mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix64)."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(parts: list[np.ndarray], salt: int) -> np.ndarray:
    """A 64-bit key of values (scrambled, in a common order)."""
    key = np.uint64(salt)
    for x in parts:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + x)
    return key


def small_requirements(size: int, small: int, least: int, threshold: Fraction) -> list[int]:
    """The overlaps that small partners of a small set of this size require."""
    partners = range(max(least, math.ceil(threshold * size)), min(small, math.floor(size / threshold)) + 1)
    return sorted({needed(size, r, threshold) for r in partners})


def list_prefix(size: int, small: int, least: int, threshold: Fraction) -> int:
    """In the inverted lists of how many of its rarest values a set is, second ones included; 0 if no partner makes that a pair with a large set."""
    low = max(least, math.ceil(threshold * size), small + 1 if size <= small else 0)
    high = math.floor(size / threshold)
    if low > high:
        return 0
    return size - needed(size, low, threshold) + 2


#: Salts of the kinds of keys; subsets of c values have the salt c.
ONE, TWO = 1 << 32, 1 << 33


def _list_keys(mixed: np.ndarray, rank: np.ndarray, prefix: int, common: np.ndarray, room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the inverted lists of sets of one size: of their rarest values, or of pairs of these where the first is common."""
    n, first = len(mixed), prefix - 1
    step = max(1, room // max(1, first))
    for start in range(0, n, step):
        rows, at = np.nonzero(~common[start : start + step])
        yield rows + start, _key([mixed[rows + start, at]], ONE)
    for k in range(first):
        rows = np.flatnonzero(common[:, k])
        step = max(1, room // (prefix - k))
        for start in range(0, len(rows), step):
            some = rows[start : start + step]
            yield np.repeat(some, prefix - 1 - k), _key([mixed[some, k, None], mixed[some, k + 1 : prefix]], TWO).ravel()


def _signatures(threshold: Fraction, small: int, least: int, common: np.ndarray):
    limit, room = COMMON, ROOM

    def batch(key: np.ndarray, c: int, ids: np.ndarray, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), c, np.int32)), pa.array(ids), pa.array(np.full(len(key), size, np.int32))], names=["key", "c", "id", "size"])

    def keys_of(ids: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = values.shape[1]
        mixed = _mix(values)
        rank = common[(mixed >> SHIFT).astype(np.int64)]
        order = np.lexsort((mixed, rank), axis=1)
        mixed, rank = np.take_along_axis(mixed, order, axis=1), np.take_along_axis(rank, order, axis=1)
        for c in small_requirements(size, small, least, threshold) if size <= small else ():
            picks = np.array(list(combinations(range(size), c)))  # of at most ``small`` values
            step = max(1, room // picks.size)
            for start in range(0, len(ids), step):
                some = mixed[start : start + step]
                yield batch(_key([some[:, picks[:, k]] for k in range(c)], c).ravel(), c, np.repeat(ids[start : start + step], len(picks)), size)
        if prefix := list_prefix(size, small, least, threshold):
            for rows, key in _list_keys(mixed, rank, prefix, rank[:, : prefix - 1] > limit, room):
                yield batch(key, 0, ids[rows], size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            ids, lists = np.asarray(one.column(0)), one.column(1)
            sizes, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                every = np.flatnonzero(sizes == size)
                step = max(1, room // int(size))
                for start in range(0, len(every), step):
                    at = every[start : start + step]
                    yield from keys_of(ids[at], flat[starts[at][:, None] + np.arange(size)])

    return run


def _common(members: DataFrame) -> np.ndarray:
    """How common the values of each bucket of scrambled values are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount((_mix(np.asarray(batch.column(0).flatten())) >> SHIFT).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = members.select("members").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most BUCKETS rows, for there are no other buckets
    found = np.zeros(BUCKETS, np.int64)
    found[np.asarray(table.column("bucket"))] = np.asarray(table.column("n"))
    return np.minimum(found, (1 << 31) - 1).astype(np.int32)


def set_classes(records: DataFrame, least: int = 1) -> DataFrame:
    """``record`` and ``class``, the least record with an equal set, of the records with at least ``least`` members."""
    sized = records.where(F.size("members") >= least).select("record", "members")
    firsts = sized.groupBy("members").agg(F.min("record").alias("class"))
    return sized.join(firsts, "members").select("record", "class", "members")


def _reaches(common: Column, size_a: Column, size_b: Column, t: Fraction) -> Column:
    """common / (size_a + size_b - common) >= t, in whole numbers."""
    return common.cast("bigint") * F.lit(t.numerator + t.denominator) >= (size_a + size_b).cast("bigint") * F.lit(t.numerator)


def similar_classes(sets: DataFrame, *, threshold: float | str, least: int = 1, small: int = 8) -> DataFrame:
    """``class_a`` < ``class_b``, ``n_common``, ``size_a``, ``size_b``: every pair of different sets that reaches ``threshold``.

    ``sets`` has one row per ``class`` with ``members`` (distinct, non-null BIGINTs), each set once.
    Sets below ``least`` members take no part. The threshold is read as a decimal, and equality counts.
    ``small`` must be so large that every larger set needs at least two common values.
    """
    t = Fraction(str(threshold))
    if not 0 < t <= 1:
        raise InvalidParameterError("threshold must lie in (0, 1]")
    if math.ceil(t * (small + 1)) < 2:
        raise InvalidParameterError("small is too low for this threshold: large sets must need two common values")
    sets = sets.where(F.size("members") >= max(1, least)).select(F.col("class").alias("id"), "members")
    keys = sets.mapInArrow(_signatures(t, small, max(1, least), _common(sets)), "key bigint, c int, id bigint, size int")
    a, b = (keys.select("key", "c", *[F.col(x).alias(f"{x}_{y}") for x in ("id", "size")]) for y in "ab")
    sizes = F.col("size_a") + F.col("size_b")
    need = F.floor((sizes * F.lit(t.numerator) + F.lit(t.numerator + t.denominator - 1)) / F.lit(t.numerator + t.denominator)).cast("int")
    within = (F.least("size_a", "size_b") * F.lit(t.denominator) >= F.greatest("size_a", "size_b") * F.lit(t.numerator)) & F.when(F.col("c") > 0, F.col("c") == need).otherwise(F.greatest("size_a", "size_b") > small)
    met = a.join(b, ["key", "c"]).where((F.col("id_a") < F.col("id_b")) & within).select("id_a", "id_b").distinct()
    of_a, of_b = (sets.select(F.col("id").alias(f"id_{y}"), F.col("members").alias(f"members_{y}")) for y in "ab")
    pairs = met.join(of_a, "id_a").join(of_b, "id_b")
    pairs = pairs.select(
        F.col("id_a").alias("class_a"), F.col("id_b").alias("class_b"), F.size(F.array_intersect("members_a", "members_b")).alias("n_common"), F.size("members_a").alias("size_a"), F.size("members_b").alias("size_b")
    )
    return pairs.where(_reaches(F.col("n_common"), F.col("size_a"), F.col("size_b"), t))


def similar_sets(records: DataFrame, *, threshold: float | str, least: int = 1, small: int = 8) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and the similar pairs of classes: ``(record, class)`` and the result of ``similar_classes``.

    Records of one class are similar to each other, and to all records of a similar class; nothing is
    lost by not writing them out (``record_pairs`` does).
    """
    classes = cut(set_classes(records, max(1, least)))
    sets = classes.where(F.col("record") == F.col("class")).select("class", "members")
    return classes.select("record", "class"), similar_classes(sets, threshold=threshold, least=least, small=small)


def _blocks(classes: DataFrame) -> DataFrame:
    """``record``, ``class``, ``block``: a class of very many records is cut into blocks of about ``CLASS_BLOCK``, and ``n_blocks``."""
    sizes = classes.groupBy("class").agg(F.count("*").alias("n_of_class")).where(F.col("n_of_class") > CLASS_BLOCK)
    joined = classes.join(sizes.select("class", F.expr(f"(n_of_class - 1) div {CLASS_BLOCK} + 1").cast("int").alias("n_blocks")), "class", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    return joined.withColumn("block", F.pmod(F.xxhash64("record"), F.col("n_blocks")).cast("int"))


def _expanded(pairs: DataFrame, blocked: DataFrame, side: str) -> DataFrame:
    """``pairs`` with the records of the class of one side; a pair with a class of many blocks goes to each block."""
    key = f"class_{side}"
    spread = blocked.where("n_blocks > 1").groupBy("class").agg(F.max("n_blocks").alias("n_blocks")).select(F.col("class").alias(key), "n_blocks")
    placed = pairs.join(spread, key, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("n_blocks", F.lit(1)) - 1))).drop("n_blocks")
    return placed.join(blocked.select(F.col("class").alias(key), "block", F.col("record").alias(f"record_{side}")), [key, "block"]).drop("block", key)


def record_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``record_a`` < ``record_b``: every similar pair of records, those of one class included.

    Records of large classes are joined block by block, so that no task writes all pairs of a class.
    """
    blocked = cut(_blocks(classes))
    mine = blocked.select("class", F.col("record").alias("record_a"), F.col("block").alias("block_a"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block_b"))
    theirs = blocked.select("class", F.col("record").alias("record_b"), F.col("block").alias("block_b"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block_a"))
    same = mine.join(theirs, ["class", "block_a", "block_b"]).where("record_a < record_b").select("record_a", "record_b")
    across = _expanded(_expanded(pairs.select("class_a", "class_b"), blocked, "a"), blocked, "b")
    return same.unionByName(across.select(F.least("record_a", "record_b").alias("record_a"), F.greatest("record_a", "record_b").alias("record_b")))


def record_links(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``record``, ``class`` and ``n_links``, the number of records similar to it: the pairs of ``record_pairs`` without writing them out."""
    sizes = cut(classes.groupBy("class").agg(F.count("*").alias("n")))
    both = pairs.select(F.explode(F.array(F.struct(F.col("class_a").alias("class"), F.col("class_b").alias("other")), F.struct(F.col("class_b").alias("class"), F.col("class_a").alias("other")))).alias("x")).select("x.*")
    others = both.join(sizes.select(F.col("class").alias("other"), "n"), "other").groupBy("class").agg(F.sum("n").alias("n_others"))
    links = sizes.join(others, "class", "left").select("class", (F.col("n") - 1 + F.coalesce("n_others", F.lit(0))).alias("n_links"))
    return classes.select("record", "class").join(links, "class").select("record", "class", "n_links")


def similar_between(left: DataFrame, right: DataFrame, *, threshold: float | str, least: int = 1, small: int = 8) -> DataFrame:
    """``record_a`` of ``left`` and ``record_b`` of ``right``, every similar pair between two tables of records.

    The tables' sets are classified together, so that a set of both is compared once; pairs within a
    table are not written out. Record ids of the two tables may clash: a class is the number that its
    set has in the table of distinct sets.
    """
    sides = [df.where(F.size("members") >= max(1, least)).select("record", F.lit(k).alias("side"), "members") for k, df in enumerate((left, right))]
    both = sides[0].unionByName(sides[1])
    sets = cut(both.select("members").distinct().select(F.monotonically_increasing_id().alias("class"), "members"))
    member = both.join(sets, "members").select("record", "side", "class")
    member = cut(member)
    blocked = [cut(_blocks(member.where(F.col("side") == k).select("record", "class"))) for k in (0, 1)]
    pairs = similar_classes(sets, threshold=threshold, least=least, small=small).select("class_a", "class_b")
    ways = pairs.unionByName(pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"))).unionByName(sets.select(F.col("class").alias("class_a"), F.col("class").alias("class_b")))
    return _expanded(_expanded(ways, blocked[0], "a"), blocked[1], "b").select("record_a", "record_b")
