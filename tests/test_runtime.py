import os

from pyspark.sql import functions as F

from polyad import runtime
from polyad.runtime import Rounds, cut, is_mounted, session_root


def tables(spark):
    root = session_root(spark).removeprefix("file://")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_rounds_give_space_back(spark):
    kept = cut(spark.range(3))
    before, rounds = tables(spark), Rounds()
    now = rounds.cut(spark.range(5).select(F.col("id").alias("x")))
    for _ in range(6):
        now = rounds.cut(now.select(F.col("x") + 1))
        now = now.toDF("x")
    assert len(tables(spark) - before) == 2 and sorted(r.x for r in now.collect()) == list(range(6, 11))
    assert kept.count() == 3


def test_folder_of_files(spark, monkeypatch):
    """A root of another scheme is no folder that workers can open by its path."""
    assert is_mounted(spark)
    monkeypatch.setattr(runtime, "shared_root", lambda s: "/somewhere")
    assert is_mounted(spark)  # files are the default file system here
    monkeypatch.setattr(runtime, "shared_root", lambda s: "har:///somewhere.har")
    try:
        assert not is_mounted(spark)
    except Exception as e:  # a file system that isn't there is no folder of files either
        assert "har" in str(e)
