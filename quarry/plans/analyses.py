"""Queries of score tables, agreement, paired outcomes and significance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import analysis as A
from quarry.plans import common as C
from quarry.plans.registry import query

J = "WITH " + C.JUDGED_SQL


def judged(spark, sf):
    return C.judged_scores(spark, sf)


def rounded(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("a01_mean_scores", J + " SELECT judge, model, round(avg(score), 3) AS mean, round(stddev_samp(score), 3) AS std, count(score) AS n FROM judged GROUP BY judge, model")
def a01(spark, sf):
    return A.mean_scores(judged(spark, sf), ["judge", "model"])


@query("a02_scores_with_average", J + " SELECT model, CASE WHEN grouping(judge) = 1 THEN 'Average' ELSE judge END AS judge, round(avg(score), 3) AS mean, round(stddev_samp(score), 3) AS std, count(score) AS n FROM judged GROUP BY GROUPING SETS ((model, judge), (model))")
def a02(spark, sf):
    return A.with_average(judged(spark, sf), ["model"], "judge")


@query("a03_pivot_mean", J + " SELECT judge, " + ", ".join(f"round(avg(CASE WHEN bucket = '{b}' THEN score END), 3) AS {b}" for b in ("long", "short")) + " FROM judged GROUP BY judge")
def a03(spark, sf):
    return A.pivot_mean(judged(spark, sf), "judge", "bucket", ["long", "short"])


@query("a04_pivot_against_baseline", J + ", p AS (SELECT model, " + ", ".join(f"round(avg(CASE WHEN judge = '{j}' THEN score END), 3) AS {j}" for j in "ANR") + " FROM judged GROUP BY model) SELECT *, round(N - A, 3) AS N_vs_A, round(R - A, 3) AS R_vs_A FROM p")
def a04(spark, sf):
    return A.against(A.pivot_mean(judged(spark, sf), "model", "judge", list("ANR")), "A", list("ANR"))


@query("a05_spread_within_items", J + ", s AS (SELECT group_id, judge, stddev_samp(score) AS s FROM judged GROUP BY ALL) SELECT judge, round(avg(s), 6) AS mean_std, count(s) AS n_items FROM s GROUP BY judge")
def a05(spark, sf):
    return rounded(A.spread_within(judged(spark, sf), ["group_id"], "judge"))


@query("a06_mean_of_means", J + ", s AS (SELECT group_id, model, avg(score) AS m FROM judged GROUP BY ALL) SELECT model, round(avg(m) / 5, 6) AS mean, count(*) AS n_items FROM s GROUP BY model")
def a06(spark, sf):
    return rounded(A.mean_of_means(judged(spark, sf), "group_id", "model", scale=5.0))


@query("a07_agreement", J + " SELECT round(corr(score, l_quantity), 4) AS pearson, round(avg(abs(score - l_quantity)), 4) AS mean_abs_diff, count(*) AS n FROM judged")
def a07(spark, sf):
    return rounded(A.agreement(judged(spark, sf), "score", "l_quantity"), 4)


@query("a08_coverage", "SELECT lang, count(*) AS total, count(quality) AS filled, round(count(quality) / count(*), 6) AS coverage, count(quality) / count(*) < 0.95 AS warn FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def a08(spark, sf):
    rows = C.docs(spark, sf).join(C.table(spark, sf, "labels"), "doc_id", "left")
    return rounded(A.coverage(rows, ["lang"], "quality"))


@query("a09_degradation", J + """, b AS (SELECT judge, avg(score) AS m, stddev_samp(score) AS s FROM judged WHERE model = 'O' GROUP BY judge),
g AS (SELECT judge, round(avg(score), 3) AS mean, round(stddev_samp(score), 3) AS std, count(score) AS n FROM judged WHERE model = 'F' GROUP BY judge)
SELECT g.judge, g.mean, g.std, g.n, round(round(b.m, 3), 6) AS base_mean, round((round(b.m, 3) - g.mean) / round(b.s, 3), 6) AS z, coalesce((round(b.m, 3) - g.mean) / round(b.s, 3) > 1.5 OR round(b.m, 3) - g.mean > 0.5, false) AS degraded FROM g LEFT JOIN b USING (judge)""")
def a09(spark, sf):
    rows = judged(spark, sf)
    means = lambda m: A.mean_scores(rows.where(F.col("model") == m), ["judge"])
    return rounded(A.degraded(means("F"), means("O"), ["judge"]))


@query("a16_two_by_two", J + ", p AS (SELECT l_quantity > 20 AS a, l_discount > 0.05 AS b FROM judged), c AS (SELECT count(*) AS n, count(CASE WHEN a AND b THEN 1 END) AS \"both\", count(CASE WHEN NOT a AND b THEN 1 END) AS loss, count(CASE WHEN a AND NOT b THEN 1 END) AS win, count(CASE WHEN NOT a AND NOT b THEN 1 END) AS neither FROM p) SELECT *, round(\"both\" / n, 6) AS both_share, round(loss / n, 6) AS loss_share, round(win / n, 6) AS win_share, round(neither / n, 6) AS neither_share, greatest(loss - win, 0) AS excess FROM c")
def a16(spark, sf):
    return rounded(A.outcomes(judged(spark, sf).select((F.col("l_quantity") > 20).alias("a"), (F.col("l_discount") > 0.05).alias("b")), "a", "b"))


@query("a17_two_proportions", J + """, c AS (SELECT count(CASE WHEN model = 'O' THEN 1 END) AS n1, count(CASE WHEN model = 'O' AND score > 2 THEN 1 END) AS k1, count(CASE WHEN model = 'F' THEN 1 END) AS n2, count(CASE WHEN model = 'F' AND score > 2 THEN 1 END) AS k2 FROM judged),
z AS (SELECT *, k1 / n1 AS p1, k2 / n2 AS p2, (k1 + k2) / (n1 + n2) AS p FROM c) SELECT n1, n2, round(p1, 6) AS p1, round(p2, 6) AS p2, round((p1 - p2) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), 4) AS z, round(p1 / p2, 6) AS risk_ratio FROM z""")
def a17(spark, sf):
    out = A.two_proportions(judged(spark, sf).withColumn("flag", F.col("score") > 2), "flag", "model", "O", "F")
    return rounded(out.drop("p_value")).withColumn("z", F.round("z", 4))


@query("a18_mann_whitney", J + """, k AS (SELECT score AS v, model FROM judged), t AS (SELECT v, count(CASE WHEN model = 'O' THEN 1 END) AS a, count(*) AS c FROM k GROUP BY v),
r AS (SELECT *, coalesce(sum(c) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2 AS rank FROM t), s AS (SELECT sum(a * rank) AS r, sum(a) AS n1, sum(c - a) AS n2, sum(c * c * c - c) AS ties FROM r),
u AS (SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, r - n1 * (n1 + 1) / 2 AS u, ties FROM s) SELECT n1, n2, round(u, 1) AS u, round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial FROM u""")
def a18(spark, sf):
    out = A.mann_whitney(judged(spark, sf), "score", "model", "O", "F")
    return out.select("n1", "n2", F.round("u", 1).alias("u"), F.round("rank_biserial", 6).alias("rank_biserial"))


@query("a19_medians", J + " SELECT judge, round(quantile_cont(l_quantity, 0.5), 6) AS median FROM judged GROUP BY judge")
def a19(spark, sf):
    return judged(spark, sf).groupBy("judge").agg(F.round(F.percentile("l_quantity", F.lit(0.5)), 6).alias("median"))


@query("a20_ratio_percentiles", "WITH r AS (SELECT round(length(text) / greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))), 6) AS v, row_number() OVER (ORDER BY length(text) / greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT q AS quantile, v AS value FROM r, (SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS q) WHERE i = least(floor(q * n), n - 1)")
def a20(spark, sf):
    from quarry.functions.text import word_count

    rows = C.docs(spark, sf).select(F.round(F.length("text") / F.greatest(F.lit(1), word_count(F.col("text"))), 6).alias("v"))
    return A.rank_percentile(rows, "v", [0.05, 0.5, 0.95])


@query("a21_token_budget", "WITH t AS (SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM t) SELECT (SELECT n FROM r WHERE i = floor(0.5 * c)) AS p50, (SELECT n FROM r WHERE i = floor(0.99 * c)) AS p99, max(n) AS most, round(avg(CASE WHEN n > 512 THEN 1.0 ELSE 0 END), 6) AS over FROM t")
def a21(spark, sf):
    from quarry.functions.text import word_count

    rows = C.docs(spark, sf).select(word_count(F.col("text")).alias("n"))
    p = A.rank_percentile(rows, "n", [0.5, 0.99]).groupBy().pivot("quantile", [0.5, 0.99]).agg(F.first("value"))
    return p.toDF("p50", "p99").crossJoin(rows.agg(F.max("n").alias("most"), F.round(F.avg((F.col("n") > 512).cast("double")), 6).alias("over")))


@query("a24_latency", "SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(count(value) / sum(value), 6) AS throughput FROM events")
def a24(spark, sf):
    return rounded(A.latency(C.table(spark, sf, "events"), "value"))


@query("a26_cost", "SELECT sum(n_chars)::BIGINT AS tokens_in, sum(n_chars // 2)::BIGINT AS tokens_out, round((sum(n_chars) * 0.25 + sum(n_chars // 2) * 1.5) / 1e6 * 0.5, 6) AS cost FROM documents")
def a26(spark, sf):
    rows = C.docs(spark, sf).select("n_chars", F.floor(F.col("n_chars") / 2).alias("half"))
    return rounded(A.cost(rows, "n_chars", "half", 0.25, 1.5))


@query("a27_cost_estimate", "WITH s AS (SELECT avg(n_chars) AS m FROM documents WHERE doc_id % 10 = 0), n AS (SELECT count(*) AS n FROM documents) SELECT n AS n_rows, round(m, 6) AS mean_tokens, round(n * (m + 120), 4) AS tokens_in, round(n * m * 0.95, 4) AS tokens_out, round((n * (m + 120) * 0.25 + n * m * 0.95 * 1.5) / 1e6, 6) AS cost FROM s, n")
def a27(spark, sf):
    rows = C.docs(spark, sf)
    out = rounded(A.cost_estimate(rows.where("doc_id % 10 = 0").select(F.col("n_chars").alias("n_tokens")), rows))
    return out.withColumn("tokens_in", F.round("tokens_in", 4)).withColumn("tokens_out", F.round("tokens_out", 4))


@query("a28_distinct_counts", J + " SELECT count(DISTINCT judge) AS judges, count(DISTINCT model) AS models, count(DISTINCT item) AS items FROM judged")
def a28(spark, sf):
    return judged(spark, sf).agg(F.countDistinct("judge").alias("judges"), F.countDistinct("model").alias("models"), F.countDistinct("item").alias("items"))


@query("a29_value_counts", "SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents GROUP BY source")
def a29(spark, sf):
    counted = C.docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source")).cast("long"))


@query("a30_cross_tab", "SELECT source, " + ", ".join(f"count(CASE WHEN lang = '{x}' THEN 1 END) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source")
def a30(spark, sf):
    return A.cross_tab(C.docs(spark, sf), "source", "lang", ["de", "en", "es", "fr"])


@query("a32_latest_entries", "SELECT o_custkey, arg_max(o_orderkey, o_orderdate + o_orderkey * INTERVAL 1 MICROSECOND) AS o_orderkey FROM orders GROUP BY o_custkey")
def a32(spark, sf):
    from quarry.operators.enrichment import latest

    rows = C.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return latest(rows, ["o_custkey"], "at").select("o_custkey", "o_orderkey")


@query("a33_merged_progress", "SELECT s, count(*) AS parts, round(sum(v), 4) AS cost FROM (SELECT event_type AS s, value AS v FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type, value FROM events WHERE event_id % 2 = 1) GROUP BY s")
def a33(spark, sf):
    e = C.table(spark, sf, "events")
    parts = [e.where(f"event_id % 2 = {i}").select(F.col("event_type").alias("s"), F.col("value").alias("v")) for i in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("s").agg(F.count("*").alias("parts"), F.round(F.sum("v"), 4).alias("cost"))


@query("a34_wins_and_losses", J + " SELECT count(CASE WHEN score > l_quantity / 10 THEN 1 END) AS wins, count(CASE WHEN score < l_quantity / 10 THEN 1 END) AS losses, count(CASE WHEN score = l_quantity / 10 THEN 1 END) AS ties FROM judged")
def a34(spark, sf):
    return A.win_loss(judged(spark, sf).withColumn("q", F.col("l_quantity") / 10), "score", "q")


@query("a35_same_words", "SELECT round(avg(CASE WHEN a = b THEN 1.0 ELSE 0 END), 6) AS identical, round(avg(CASE WHEN list_sort(list_distinct(string_split(a, ' '))) = list_sort(list_distinct(string_split(b, ' '))) THEN 1.0 ELSE 0 END), 6) AS same_words FROM (SELECT p_type || ' ' || p_brand AS a, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' ' || p_type ELSE p_type END AS b FROM part)")
def a35(spark, sf):
    t = C.table(spark, sf, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("a"), F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_brand", "p_type")).otherwise(F.col("p_type")).alias("b"))
    return rounded(A.same_words(t, "a", "b"))


@query("a10_rejoined_segments", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey) AS parts, count(*) AS n_segments FROM lineitem GROUP BY l_orderkey")
def a10(spark, sf):
    from quarry.operators.enrichment import rejoined

    rows = C.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("parts"))
    rows = rows.withColumn("l_linenumber", F.struct("l_linenumber", F.col("parts").cast("long").alias("p")))
    return rejoined(rows, "l_orderkey", "l_linenumber", "parts")


@query("a41_struct_to_columns", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_returnflag")
def a41(spark, sf):
    rows = C.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.struct(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total")).alias("results"))
    return rows.select("l_returnflag", "results.*")


@query("r23_model_dataset_pivot", J + " SELECT model, " + ", ".join(f"round(avg(CASE WHEN judge = '{j}' THEN l_discount END), 4) AS {j}" for j in "ANR") + " FROM judged GROUP BY model")
def r23(spark, sf):
    return A.pivot_mean(judged(spark, sf), "model", "judge", list("ANR"), "l_discount", 4)


@query("l04_largest_gaps", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity - l_discount * 100, 6) AS gap FROM lineitem ORDER BY round(l_quantity - l_discount * 100, 6) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20")
def l04(spark, sf):
    t = C.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_quantity") - F.col("l_discount") * 100, 6).alias("gap"))
    return t.orderBy(F.desc("gap"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(20)


@query("l05_most_common", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10")
def l05(spark, sf):
    return C.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)


@query("w15_average_ranks", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2 AS avg_rank FROM orders")
def w15(spark, sf):
    r = F.rank().over(Window.partitionBy("o_orderpriority").orderBy("o_custkey"))
    ties = F.count("*").over(Window.partitionBy("o_orderpriority", "o_custkey"))
    return C.table(spark, sf, "orders").select("o_orderkey", (r + (ties - 1) / 2).alias("avg_rank"))


@query("w14_partition_maximum", "SELECT l_orderkey, l_linenumber, l_partkey, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS most FROM lineitem")
def w14(spark, sf):
    return C.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.max("l_linenumber").over(Window.partitionBy("l_orderkey")).alias("most"))


@query("j11_ranks_side_by_side", "WITH a AS (SELECT l_orderkey AS qid, min(l_linenumber) AS r FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_orderkey AS qid, min(l_linenumber) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT a.qid, a.r AS rank_a, b.r AS rank_b, a.r <= 2 AS hit_a, b.r <= 2 AS hit_b, round(1.0 / a.r - 1.0 / b.r, 6) AS gap FROM a JOIN b USING (qid)")
def j11(spark, sf):
    t = C.table(spark, sf, "lineitem")
    side = lambda f, n: t.where(F.col("l_returnflag") == f).groupBy(F.col("l_orderkey").alias("qid")).agg(F.min("l_linenumber").alias(n))
    both = side("A", "rank_a").join(side("R", "rank_b"), "qid")
    return both.select("qid", "rank_a", "rank_b", (F.col("rank_a") <= 2).alias("hit_a"), (F.col("rank_b") <= 2).alias("hit_b"), F.round(1.0 / F.col("rank_a") - 1.0 / F.col("rank_b"), 6).alias("gap"))
