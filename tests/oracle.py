"""Runs queries and their SQL side by side, as the driver does: rows as a multiset, columns by name."""

import os
import sys
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if v != v else v + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in records)


def compare(spark, con, sf_dir, name, query, sql):
    """An empty text if they agree, else what differs."""
    df = query(spark, sf_dir)
    a_names, a = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return ""
    cur = con.execute(sql)
    b_names, b = rows([d[0] for d in cur.description], cur.fetchall())
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:2]}; only there {list((b - a).items())[:2]}"
    return ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    from quarry.plans import registry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = "/root/testdata/sf0.01"
    con = connect(sf)
    bad = 0
    sql = registry.oracle_sql()
    for name, q in registry.queries().items():
        if len(sys.argv) > 1 and not any(name.startswith(x) for x in sys.argv[1:]):
            continue
        t = time.time()
        try:
            said = compare(spark, con, sf, name, q, sql.get(name))
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said)
        print(f"{name} {time.time() - t:.1f}s {'-' if name not in sql else ''} {said or 'ok'}", flush=True)
    print(f"{bad} differ")
