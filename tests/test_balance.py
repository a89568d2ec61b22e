import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from polyad.errors import InvalidParameterError
from polyad.operators import balance
from polyad.operators.balance import balanced_aggregate, balanced_apply, chunk_rows, number_rows, reads_alike
from polyad.runtime import cut

SCHEMA = "k bigint, v double, n string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(rng.choice([7, 7, 7, 7, None, rng.randint(0, 50)]), rng.choice([None, float(i)]), f"row {i}") for i in range(3000)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return cut(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_numbers_are_exact(df):
    found = number_rows(df, "k").collect()
    assert sorted(r["__number"] for r in found) == list(range(3000))
    of_key = {}
    for r in sorted(found, key=lambda r: r["__number"]):
        of_key.setdefault(r["__key"], []).append(r["__row"])
    assert all(x == list(range(len(x))) for x in of_key.values())  # a key's rows lie together, in order


def test_chunks_are_equal(df):
    sizes = [r["count"] for r in chunk_rows(df, "k", chunk=700, columns=[]).groupBy("__chunk").count().orderBy("__chunk").collect()]
    assert sizes == [700, 700, 700, 700, 200]


@pytest.mark.parametrize("chunk", [1, 97, 10_000])
def test_aggregates(df, rows, chunk):
    found = balanced_aggregate(
        df, "k", {"n": ("count", F.lit(1)), "total": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v")), "a": ("first", F.col("n")), "z": ("last", F.col("n"))}, chunk=chunk
    ).collect()
    frame = pd.DataFrame(rows, columns=["k", "v", "n"])
    stored = pd.DataFrame([(r["__key"], r["n"], r["__row"]) for r in number_rows(df, "k").collect()], columns=["k", "n", "row"]).sort_values("row")
    assert len(found) == frame["k"].nunique(dropna=False)
    for r in found:
        mine = frame[frame["k"].isna() if r["__key"] is None else frame["k"] == r["__key"]]
        order = stored[stored["k"].isna() if r["__key"] is None else stored["k"] == r["__key"]]
        assert (r.n, r.total or 0.0) == (len(mine), mine["v"].sum())
        assert (r.low, r.high) == ((None, None) if mine["v"].isna().all() else (mine["v"].min(), mine["v"].max()))
        assert (r.a, r.z) == (order["n"].iloc[0], order["n"].iloc[-1])


def test_any_function_with_ordered_states(df):
    """Longest run of present values in stored order: needs the boundary states in order."""

    def state(rows):
        out = []
        for name, part in rows.groupby("__key", dropna=False, sort=False):
            flags = part["v"].notna().tolist()
            best = run = 0
            for x in flags:
                run = run + 1 if x else 0
                best = max(best, run)
            out.append((name, len(flags), flags.index(False) if False in flags else len(flags), run, best))
        return pd.DataFrame(out, columns=["__key", "size", "head", "tail", "best"])

    def merge(states):
        out = []
        for name, part in states.groupby("__key", dropna=False):
            best = tail = 0
            for s in part.itertuples():
                best = max(best, s.best, tail + s.head)
                tail = tail + s.size if s.head == s.size else s.tail
            out.append((name, best))
        return pd.DataFrame(out, columns=["__key", "longest"])

    got = {r["__key"]: r.longest for r in balanced_apply(df, "k", state, "size long, head long, tail long, best long", merge, "longest long", chunk=130).collect()}
    want = {}
    for r in sorted(number_rows(df, "k").collect(), key=lambda r: r["__number"]):
        best, run = want.get(r["__key"], (0, 0))
        run = run + 1 if r.v is not None else 0
        want[r["__key"]] = (max(best, run), run)
    assert got == {k: b for k, (b, _) in want.items()}


def test_empty_and_clashes(spark, df):
    empty = df.limit(0)
    assert number_rows(empty, "k").collect() == []
    assert balanced_aggregate(empty, "k", {"n": ("count", F.lit(1))}).collect() == []
    with pytest.raises(InvalidParameterError):
        number_rows(df.withColumn("__row", F.lit(1)), "k")
    with pytest.raises(InvalidParameterError):
        chunk_rows(df, "k", chunk=0)
    with pytest.raises(InvalidParameterError):
        balanced_aggregate(df, "k", {"n": ("median", F.col("v"))})


def test_input_that_is_no_table(spark, tmp_path):
    """A grouped frame whose shuffle adaptive execution cuts differently for the counts and for the rows keeps all its rows."""
    path = str(tmp_path / "rows")
    spark.range(200_000).select("id", (F.col("id") % 3).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(path)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200kB", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        grouped = spark.read.parquet(path).groupBy("id").agg(F.first("k").alias("k"), F.first("text").alias("text"))
        found = number_rows(grouped, "k").agg(F.count("*"), F.min("__number"), F.max("__number"), F.countDistinct("__number")).first()
        assert tuple(found) == (200_000, 0, 199_999, 200_000)
        counts = {r["__key"]: r.n for r in balanced_aggregate(grouped, "k", {"n": ("count", F.lit(1))}, chunk=30_000).collect()}
        assert counts == {0: 66_667, 1: 66_667, 2: 66_666}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_only_plain_reads_are_read_again(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(10).select("id", F.array("id").alias("x")).write.parquet(path)
    table = spark.read.parquet(path)
    assert reads_alike(table.select(F.explode("x").alias("y")).where("y > 1").unionByName(table.select(F.col("id").alias("y"))))
    assert not reads_alike(table.distinct()) and not reads_alike(table.where(F.rand() < 0.5)) and not reads_alike(table.repartition(3))


def test_changed_input_is_an_error(spark, df, monkeypatch):
    """Offsets that don't fit the rows end in an error, never in lost rows."""
    whole = balance.key_offsets
    monkeypatch.setattr(balance, "key_offsets", lambda placed, key: whole(placed, key).withColumn("n", F.col("n") - 1))
    with pytest.raises(Exception, match="other rows or partitions"):
        number_rows(df, "k").collect()
    monkeypatch.setattr(balance, "key_offsets", lambda placed, key: whole(placed, key).where("k IS NULL" if key == "k" else f"`{key}` IS NULL"))
    with pytest.raises(Exception, match="other rows or partitions"):
        number_rows(df, "k").collect()


def test_a_chunk_lies_in_one_partition(df):
    placed = chunk_rows(df, "k", chunk=250, columns=[]).withColumn("p", F.spark_partition_id()).groupBy("__chunk").agg(F.countDistinct("p").alias("n"), F.count("*").alias("rows")).collect()
    assert len(placed) == 12 and all((r.n, r.rows) == (1, 250) for r in placed)
