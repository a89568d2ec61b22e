"""References to records that are missing, deleted or not there yet.

A reference made at time t is sound if its key is alive at t in the log of the table it refers to: the
latest entry with arrival <= t is not a deletion. Logs become intervals of life. References are counted
per key and period, with the first and last time of each; these counts are checked, not the rows:

* a count whose whole span lies in one life is sound, one that no life touches is orphan as a whole;
* only where a key's life changes within the span do its rows have to be looked at one by one.

Keys with a large share of the references are heavy. Their counts, few by construction, are broadcast to
the lives; the counts of all other keys meet the lives in an anti-join on the key. The orphans of both
are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyad.runtime import bounded_rows, cut

#: A key with at least this share of the references of its field is heavy; so at most 1 / HEAVY are.
HEAVY = 1 / 512
#: Rows of life intervals (of heavy keys, by day) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def life_intervals(log: DataFrame, key: str, deleted: Column, at: str) -> DataFrame:
    """``key``, ``since`` and ``until`` (null while it lasts): when each key is alive.

    ``deleted`` tells of a row whether it deletes. Rows without key or time are ignored. If several rows
    of a key have the same time, a deletion among them decides. Repeated states are dropped first within
    a day, then within a key, so that a key with very many entries is never sorted as one group.
    """
    events = log.select(F.col(key).alias("key"), F.col(at).alias("t"), F.coalesce(deleted, F.lit(False)).alias("gone"))
    events = events.where("key IS NOT NULL AND t IS NOT NULL").groupBy("key", "t").agg(F.max("gone").alias("gone"))
    for group in (Window.partitionBy("key", F.to_date("t")), Window.partitionBy("key")):
        events = events.withColumn("before", F.lag("gone").over(group.orderBy("t")))
        events = events.where(F.col("before").isNull() | (F.col("before") != F.col("gone"))).drop("before")
    spans = events.withColumn("until", F.lead("t").over(Window.partitionBy("key").orderBy("t")))
    return spans.where(~F.col("gone")).select("key", F.col("t").alias("since"), "until")


def _alive(t: str) -> Column:
    return (F.col(t) >= F.col("since")) & (F.col("until").isNull() | (F.col(t) < F.col("until")))


def reference_counts(refs: DataFrame) -> DataFrame:
    """``key``, ``period`` (its month's first day), ``n``, ``first`` and ``last`` time of the references, combined before the shuffle."""
    return refs.groupBy("key", F.trunc("t", "month").alias("period")).agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def _heavy_keys(counts: DataFrame) -> list:
    total = counts.agg(F.sum("n")).first()[0] or 0
    by_key = counts.groupBy("key").agg(F.sum("n").alias("n"))
    return [r.key for r in bounded_rows(by_key.where(F.col("n") >= F.lit(max(2.0, total * HEAVY))).select("key"), int(1 / HEAVY), "heavy keys")]


def unsound_counts(counts: DataFrame, lives: DataFrame) -> DataFrame:
    """The ``counts`` that aren't wholly sound, with ``heavy`` and ``mixed``: whether rows must tell which of them are orphans.

    Counts that aren't mixed are orphan as a whole. Both arguments are read several times and should be tables.
    """
    heavy = _heavy_keys(counts)
    is_heavy = F.col("key").isin(heavy) if heavy else F.lit(False)
    of_lives = lives.withColumnRenamed("key", "live_key")
    covers = (F.col("key") == F.col("live_key")) & (F.col("since") <= F.col("first")) & (F.col("until").isNull() | (F.col("until") > F.col("last")))
    touches = (F.col("key") == F.col("live_key")) & (F.col("since") <= F.col("last")) & (F.col("until").isNull() | (F.col("until") > F.col("first")))
    light = cut(counts.where(~is_heavy).join(of_lives, covers, "left_anti"))
    touched = light.join(of_lives, touches, "left_semi").withColumn("mixed", F.lit(True))
    untouched = light.join(of_lives, touches, "left_anti").withColumn("mixed", F.lit(False))
    found = touched.unionByName(untouched).withColumn("heavy", F.lit(False))
    if heavy:
        few = counts.where(is_heavy)  # at most 1 / HEAVY keys, a row per month
        met = of_lives.where(F.col("live_key").isin(heavy)).join(F.broadcast(few), touches).groupBy("key", "period").agg(F.max(covers).alias("covered"))
        states = few.join(F.broadcast(met), ["key", "period"], "left").where(~F.coalesce("covered", F.lit(False)))
        found = found.unionByName(states.withColumn("mixed", F.col("covered").isNotNull()).withColumn("heavy", F.lit(True)).drop("covered"))
    return cut(found)


def _rows_of(refs: DataFrame, groups: DataFrame) -> DataFrame:
    """The references of some (key, period) groups: few groups are broadcast, and those of heavy keys always, else both are shuffled."""
    placed = refs.withColumn("period", F.trunc("t", "month"))
    of = lambda some: some.select("key", "period", "mixed", "heavy")
    if groups.count() <= BROADCAST_ROWS:
        return placed.join(F.broadcast(of(groups)), ["key", "period"])
    dense = placed.join(F.broadcast(of(groups.where("heavy"))), ["key", "period"])
    return dense.unionByName(placed.join(of(groups.where("NOT heavy")), ["key", "period"]))


def _orphans_among(rows: DataFrame, lives: DataFrame) -> DataFrame:
    """The orphans among references of mixed groups, one by one."""
    of_lives = lives.withColumnRenamed("key", "live_key")
    light = rows.where("NOT heavy").join(of_lives, (F.col("key") == F.col("live_key")) & _alive("t"), "left_anti")
    dense = rows.where("heavy")
    last = dense.agg(F.max("t")).first()[0]
    if last is None:
        return light
    # by day, so that a reference meets only the intervals of its own day, however often a key came and went
    most = F.to_date(F.lit(last))
    days = F.explode(F.sequence(F.to_date("since"), F.greatest(F.to_date("since"), F.least(F.to_date("until"), most))))
    dense_lives = cut(of_lives.join(F.broadcast(dense.select(F.col("key").alias("live_key")).distinct()), "live_key", "left_semi").select("live_key", "since", "until", days.alias("day")))
    if dense_lives.count() <= BROADCAST_ROWS:
        dense_lives = F.broadcast(dense_lives)
    met = (F.col("key") == F.col("live_key")) & (F.col("ref_day") == F.col("day")) & _alive("t")
    return light.unionByName(dense.withColumn("ref_day", F.to_date("t")).join(dense_lives, met, "left_anti").drop("ref_day"))


def orphan_references(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """The rows of ``refs`` (``ref``, ``key``, ``t``; key and t not null) whose key isn't alive at t.

    ``lives`` is the result of ``life_intervals``; it is written once. ``refs`` is read several times and
    should be a table. Rows are read for the unsound (key, period) groups only, and compared with lives
    only in mixed ones. Empty tables give an empty result; repeated references stay.
    """
    lives = cut(lives)
    groups = unsound_counts(cut(reference_counts(refs)), lives)
    rows = _rows_of(refs, groups)
    mixed = cut(rows.where("mixed"))
    return rows.where("NOT mixed").select(refs.columns).unionByName(_orphans_among(mixed, lives).select(refs.columns))


def orphan_counts(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """``period`` and ``n_orphans`` of the references that ``orphan_references`` finds, from the counts per key and period.

    Groups that are orphan as a whole are counted as they are; only the rows of mixed groups are read.
    """
    lives = cut(lives)
    groups = unsound_counts(cut(reference_counts(refs)), lives)
    whole = groups.where("NOT mixed").groupBy("period").agg(F.sum("n").alias("n"))
    single = _orphans_among(cut(_rows_of(refs, groups.where("mixed"))), lives).groupBy("period").agg(F.count("*").alias("n"))
    return whole.unionByName(single).groupBy("period").agg(F.sum("n").alias("n_orphans"))


def first_deliveries(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """One row per key, its earliest by ``at``; of several at that time the least in ``columns``.

    Rows without key or time are left out. Aggregated before the shuffle.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("ref"), F.struct(F.col(at).alias("t"), *[F.col(c).alias(c) for c in columns]).alias("row"))
    return rows.groupBy("ref").agg(F.min("row").alias("row")).select("ref", "row.*")
