"""Relational and event-time queries beyond the reference's own operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.plans import common as C
from quarry.plans.registry import query
from quarry.streaming.ladder import sessions, tumbling


@query("i08_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def i08(spark, sf):
    out = tumbling(C.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("i08_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, sid""")
def i08s(spark, sf):
    out = sessions(C.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("a37_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a37(spark, sf):
    return C.table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("a38_approximate_distinct")
def a38(spark, sf):
    return C.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))


@query("w17_lag_and_tiles", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after, ntile(4) OVER w AS tile, round(percent_rank() OVER w, 6) AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w17(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return C.table(spark, sf, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice").over(w).alias("after"), F.ntile(4).over(w).alias("tile"), F.round(F.percent_rank().over(w), 6).alias("place"))


@query("j22_as_of_join", "SELECT e.event_id, o.o_orderdate FROM (SELECT event_id, ts - INTERVAL 28 YEAR AS ts FROM events) e ASOF LEFT JOIN (SELECT DISTINCT o_orderdate FROM orders) o ON e.ts >= o.o_orderdate")
def j22(spark, sf):
    """The last order date at or before each event, by a union in order of time instead of a range join."""
    e = C.table(spark, sf, "events").select("event_id", F.expr("ts - interval 28 years").alias("at"), F.lit(None).cast("timestamp_ntz").alias("o"))
    o = C.table(spark, sf, "orders").select(F.lit(None).cast("long").alias("event_id"), F.col("o_orderdate").alias("at"), F.col("o_orderdate").alias("o")).distinct()
    month = F.date_trunc("month", F.col("at").cast("timestamp")).cast("timestamp_ntz")
    rows = e.unionByName(o).withColumn("month", month)
    # Within a month by a window; what a month begins with is the last of earlier months, one row each.
    last = rows.groupBy("month").agg(F.max("o").alias("m"))
    before = last.select("month", F.max("m").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    inside = F.last("o", ignorenulls=True).over(Window.partitionBy("month").orderBy("at", F.col("o").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inside", inside).join(F.broadcast(before), "month").where("event_id is not null").select("event_id", F.coalesce("inside", "earlier").alias("o_orderdate"))


@query("j22_range_join", "SELECT p.p_partkey, count(*) AS n FROM part p JOIN supplier s ON s.s_acctbal BETWEEN p.p_retailprice - 50 AND p.p_retailprice + 50 GROUP BY p.p_partkey")
def j22r(spark, sf):
    """Values within 50 of each other, by buckets of 100: an equi-join with each bucket's neighbour."""
    p = C.table(spark, sf, "part").select("p_partkey", "p_retailprice", F.explode(F.array(F.floor((F.col("p_retailprice") - 50) / 100), F.floor((F.col("p_retailprice") + 50) / 100))).alias("b")).distinct()
    s = C.table(spark, sf, "supplier").select("s_acctbal", F.floor(F.col("s_acctbal") / 100).alias("b"))
    return p.join(s, "b").where(F.col("s_acctbal").between(F.col("p_retailprice") - 50, F.col("p_retailprice") + 50)).groupBy("p_partkey").agg(F.count("*").alias("n"))
