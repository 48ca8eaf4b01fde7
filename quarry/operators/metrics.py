"""Retrieval measures over rankings (query_id, doc_id, rank[, score]) and judgements (query_id, doc_id, score).

A measure is a column of a frame with one row for each query; reports are averages of such frames, so
a subset of queries is a filter. Queries that retrieved nothing count with 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import seed64
from quarry.functions.vectors import discount, gain


def without_self(ranked: DataFrame, k: int) -> DataFrame:
    """Rankings without a query's own document: fetched one deeper, renumbered, cut at k."""
    left = ranked.where(F.col("query_id") != F.col("doc_id"))
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    return left.withColumn("rank", again).where(F.col("rank") <= k)


def id_overlap(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: share of query ids that are document ids, and whether it calls for self-exclusion (over a half)."""
    ids = docs.select(F.col("doc_id").alias("query_id")).distinct().withColumn("hit", F.lit(1))
    return queries.select("query_id").distinct().join(ids, "query_id", "left").agg((F.count("hit") / F.count("*")).alias("overlap")).withColumn("exclude_self", F.col("overlap") > 0.5)


def ideal_dcg(qrels: DataFrame, k: int, exponential: bool = False) -> DataFrame:
    """(query_id, ideal): DCG of the best possible order of all judged documents."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    best = qrels.withColumn("nth", nth)
    return best.groupBy("query_id").agg(F.sum(F.when(F.col("nth") <= k, gain(F.col("score"), exponential) * discount(F.col("nth"))).otherwise(0.0)).alias("ideal"))


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Judged documents with their rank (null: not retrieved); every judged query is in it."""
    return qrels.join(ranked.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")


def first_rank(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, n_relevant, first_rank): rank of the first relevant document, null if there is none."""
    return judged(ranked, qrels).groupBy("query_id").agg(F.count_if(F.col("score") > 0).alias("n_relevant"), F.min(F.when(F.col("score") > 0, F.col("rank"))).alias("first_rank"))


def _at(k: int) -> Column:
    return (F.col("score") > 0) & (F.col("rank") <= k)


def ndcg(rows: DataFrame, qrels: DataFrame, k: int, exponential: bool = False) -> DataFrame:
    """(query_id, ndcg) against the ideal over the full judgements."""
    dcg = rows.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, gain(F.col("score"), exponential) * discount(F.col("rank"))).otherwise(0.0)).alias("dcg"))
    return dcg.join(ideal_dcg(qrels, k, exponential), "query_id").select("query_id", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias(f"ndcg_{k}"))


def per_query(ranked: DataFrame, qrels: DataFrame, recalls: tuple[int, ...] = (1, 5, 10, 100), ndcgs: tuple[int, ...] = (10, 100), depth: int = 100) -> DataFrame:
    """Every measure of every judged query: success, hit, MRR, recall and NDCG at some depths.

    Queries with judgements of 0 only are in it, with 0 for everything.
    """
    rows = judged(ranked, qrels)
    relevant = F.greatest(F.count_if(F.col("score") > 0), F.lit(1))
    first = F.min(F.when(_at(depth), F.col("rank")))
    out = rows.groupBy("query_id").agg(
        F.count_if(F.col("score") > 0).alias("n_relevant"),
        F.coalesce((first == 1).cast("double"), F.lit(0.0)).alias("success_1"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"),
        F.coalesce(F.when(first <= 10, 1.0 / first), F.lit(0.0)).alias("mrr_10"),
        first.isNotNull().cast("double").alias("hit"),
        *((F.count_if(_at(k)) / relevant).alias(f"recall_{k}") for k in recalls),
        *((F.count_if(_at(k)) / k).alias(f"precision_{k}") for k in recalls),
        *((F.count_if(_at(k)) > 0).cast("double").alias(f"hit_{k}") for k in recalls),
    )
    for k in ndcgs:
        out = out.join(ndcg(rows, qrels, k), "query_id")
    return out


def cluster_of(qrels: DataFrame) -> DataFrame:
    """(query_id, cluster): the smallest relevant document, as text, stands for queries that share gold."""
    return qrels.where("score > 0").groupBy("query_id").agg(F.min(F.col("doc_id").cast("string")).alias("cluster"))


def report(measures: DataFrame, names: list[str], **subsets: Column) -> DataFrame:
    """Averages over all queries and over each named subset, one row each."""
    parts = {"overall": F.lit(True)} | subsets
    out = None
    for name, inside in parts.items():
        row = measures.where(inside).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in names)).select(F.lit(name).alias("subset"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def by_bin(measures: DataFrame, names: list[str], bin_col: str, visible: str) -> DataFrame:
    """Averages by position bin, by visibility and over all, by grouping sets."""
    sets = [[F.col(bin_col)], [F.col(visible)], []]
    return measures.groupingSets(sets, F.col(bin_col), F.col(visible)).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in names))


def bootstrap(measures: DataFrame, value: str, rounds: int = 1000, seed: int = 0, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row: mean of a measure and its interval when whole clusters are drawn again.

    measures: (cluster, value column). Draws are by hash. Clusters are summed first, so what is drawn
    is one row for each cluster, and a round's draws join them on their number.
    """
    clusters = measures.groupBy("cluster").agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    numbered = clusters.withColumn("nth", F.row_number().over(Window.orderBy("cluster")).cast("long") - 1)
    size = numbered.agg(F.count("*").alias("clusters"))
    draws = measures.sparkSession.range(rounds).withColumnRenamed("id", "round").crossJoin(F.broadcast(size)).select("round", "clusters", F.explode(F.sequence(F.lit(1), F.col("clusters"))).alias("draw"))
    drawn = draws.select("round", (seed64(F.lit(seed), F.col("round"), F.col("draw")) % F.col("clusters")).cast("long").alias("nth"))
    means = drawn.join(numbered, "nth").groupBy("round").agg((F.sum("total") / F.sum("n")).alias("mean"))
    place = F.row_number().over(Window.orderBy("mean", "round")).cast("long") - 1
    ends = means.withColumn("place", place).agg(F.max(F.when(F.col("place") == int(low * rounds), F.col("mean"))).alias("low"), F.max(F.when(F.col("place") == min(rounds - 1, int(high * rounds)), F.col("mean"))).alias("high"))
    whole = clusters.agg((F.sum("total") / F.sum("n")).alias("mean"), F.count("*").alias("clusters"))
    return whole.crossJoin(ends)


def paired_bootstrap(a: DataFrame, b: DataFrame, value: str, **options) -> DataFrame:
    """The same for the difference b - a over the queries, and so the clusters, that both have."""
    both = a.select("query_id", "cluster", F.col(value).alias("__a")).join(b.select("query_id", F.col(value).alias("__b")), "query_id")
    return bootstrap(both.select("cluster", (F.col("__b") - F.col("__a")).alias(value)), value, **options)


def pool_windows(scored: DataFrame, how: str = "max") -> DataFrame:
    """(query_id, doc_id, score) of documents out of their windows' scores."""
    pooled = {"max": F.max, "mean": F.avg}[how]("score")
    return scored.groupBy("query_id", "doc_id").agg(pooled.alias("score"))


def set_measures(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """One row: micro precision, recall and F1; of each row as many of the best predictions count as it has true items.

    predicted: (row_id, item, score); true: (row_id, item).
    """
    wanted = true.distinct().groupBy("row_id").agg(F.count("*").alias("k"))
    order = Window.partitionBy("row_id").orderBy(F.desc("score"), "item")
    taken = predicted.join(wanted, "row_id").withColumn("nth", F.row_number().over(order)).where("nth <= k").select("row_id", "item", F.lit(1).alias("p"))
    both = taken.join(true.distinct().withColumn("t", F.lit(1)), ["row_id", "item"], "full_outer")
    counts = both.agg(F.count_if(F.expr("p = 1 and t = 1")).alias("tp"), F.count("p").alias("np"), F.count("t").alias("nt"))
    return counts.select((F.col("tp") / F.col("np")).alias("precision"), (F.col("tp") / F.col("nt")).alias("recall"), (2 * F.col("tp") / (F.col("np") + F.col("nt"))).alias("f1"))


def diagonal(similarity: DataFrame) -> DataFrame:
    """(query_id, rank) of each query's own document in (query_id, doc_id, score)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return similarity.withColumn("rank", F.row_number().over(order).cast("long")).where("query_id = doc_id").select("query_id", "rank")


def rescored(old: DataFrame, new: DataFrame, names: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(key, measure, old, new, delta, agrees) of two reports with a column key."""
    long = lambda df, to: df.unpivot("key", names, "measure", to)
    both = long(old, "old").join(long(new, "new"), ["key", "measure"], "full_outer")
    return both.withColumn("delta", F.col("new") - F.col("old")).withColumn("agrees", F.coalesce(F.abs("delta") <= tolerance, F.lit(False)))
