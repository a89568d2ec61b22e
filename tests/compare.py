"""Compare registered queries with their SQL over a data folder: ``python tests/compare.py sf0.01 NAME...``."""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def oracle(folder, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def compare(spark, folder, query, sql):
    """Empty if the rows agree, else what differs."""
    df = query(spark, folder)
    names, rows = oracle(folder, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}", 0
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(names, rows)
    if mine != theirs:
        other = [x for x in zip(mine, theirs) if x[0] != x[1]][:3]
        return f"{len(mine)} rows against {len(theirs)}; {other}", len(mine)
    return "", len(mine)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or list(queries):
        began = time.time()
        try:
            if name in sqls:
                said, n = compare(spark, f"/root/testdata/{sys.argv[1]}", queries[name], sqls[name])
            else:
                said, n = "", len(queries[name](spark, f"/root/testdata/{sys.argv[1]}").collect())
        except Exception as e:
            said, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += bool(said)
        print(f"{name}: {'no SQL' if name not in sqls else 'same'} {n} rows, {time.time() - began:.1f} s" if not said else f"{name}: DIFFERS {said[:900]}", flush=True)
    print("bad:", bad)
