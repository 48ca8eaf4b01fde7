"""BM25 over a postings table, and hard negatives mined with it.

The index is one row for each document and term. Terms in fewer than ``min_df`` documents are dropped
before lengths, their mean and idf are computed. Corpus scalars enter by one-row cross joins, so an
index is one lazy plan. Every top-k is ordered by score, then document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X

K1, B, FLOOR = 1.5, 0.75, 0.25


def term_counts(docs: DataFrame, tokenizer: Callable[[Column], Column] = X.unicode_tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf), dealt by document, so that uses within one plan can read the same exchange.

    What joins would ask of the keys is asked here, as plans with other filters would share nothing;
    documents without an id are in no index.
    """
    terms = docs.select(F.col(id_col).alias("doc_id"), F.explode(tokenizer(F.col(text_col))).alias("term"))
    return terms.where("doc_id is not null and term is not null").groupBy("doc_id", "term").agg(F.count("*").alias("tf")).repartition("doc_id")


def _df() -> Column:
    """Documents of a term; it reads tf, as an exchange is only shared by plans that take the same columns."""
    return F.count_if(F.col("tf") > 0).alias("df")


def postings(docs: DataFrame, min_df: int = 2, tokenizer: Callable[[Column], Column] = X.unicode_tokens, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, term, tf, df, weight): idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)).

    idf is ln((N - df + 0.5) / (df + 0.5)); where that is not positive, 0.25 times its mean over all
    terms, taken before this floor.
    """
    counts = term_counts(docs, tokenizer, id_col, text_col)
    terms = counts.groupBy("term").agg(_df()).where(F.col("df") >= min_df)
    total = docs.agg(F.count("*").alias("n"))
    rated = terms.crossJoin(F.broadcast(total)).withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean_idf = rated.agg(F.avg("raw").alias("mean_idf"))
    idf = rated.crossJoin(F.broadcast(mean_idf)).select("term", "df", F.when(F.col("raw") <= 0, FLOOR * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    kept = counts.join(idf, "term")
    lengths = kept.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    mean = lengths.crossJoin(F.broadcast(total)).agg((F.sum("length") / F.max("n")).alias("mean_length"))
    norm = lengths.crossJoin(F.broadcast(mean)).select("doc_id", (k1 * (1 - b + b * F.col("length") / F.col("mean_length"))).alias("norm"))
    return kept.join(norm, "doc_id").select("doc_id", "term", "tf", "df", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + F.col("norm"))).alias("weight"))


def statistics(docs: DataFrame, min_df: int = 2, tokenizer: Callable[[Column], Column] = X.unicode_tokens) -> DataFrame:
    """One row: documents, terms, postings, mean length over all documents, mean idf before the floor."""
    counts = term_counts(docs, tokenizer)
    terms = counts.groupBy("term").agg(_df()).where(F.col("df") >= min_df)
    total = docs.agg(F.count("*").alias("n"))
    idf = terms.crossJoin(F.broadcast(total)).agg(F.count("*").alias("n_terms"), F.avg(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("mean_idf"))
    kept = counts.join(terms, "term").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"))
    return total.crossJoin(kept).crossJoin(idf).select(F.col("n").alias("n_docs"), "n_terms", "n_postings", (F.col("n_tokens") / F.col("n")).alias("mean_length"), "mean_idf")


def scores(index: DataFrame, queries: DataFrame, tokenizer: Callable[[Column], Column] = X.unicode_tokens, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score): sum over shared terms of the term's count in the query times its weight, to nine digits, so that copies tie.

    An equi-join on the term: Catalyst broadcasts the query side where it is small, and shuffles both
    otherwise; sums are combined before they are shuffled.
    """
    asked = term_counts(queries, tokenizer, id_col, text_col).select(F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("qf"))
    return index.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qf") * F.col("weight")), 9).alias("score"))


def top_k(scored: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id", banned: DataFrame | None = None) -> DataFrame:
    """The k best documents of each query with their rank; banned: pairs that are left out before ranking."""
    if banned is not None:
        scored = scored.join(banned.select(query, doc).distinct(), [query, doc], "left_anti")
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(doc))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, min_df: int = 2, banned: DataFrame | None = None, **options) -> DataFrame:
    """(query_id, doc_id, score, rank) of queries(query_id, text) over docs(doc_id, text)."""
    index = postings(docs, min_df, **options)
    return top_k(scores(index, queries, **({"tokenizer": options["tokenizer"]} if "tokenizer" in options else {})), k, banned=banned)


def hard_negatives(ranked: DataFrame, qrels: DataFrame, depth: int = 100, per_query: int = 5) -> DataFrame:
    """(query_id, doc_id, nth): the first documents of a ranking that are no positives, of its first ``depth``."""
    positives = qrels.where("score > 0").select("query_id", "doc_id").distinct()
    left = ranked.where(F.col("rank") <= depth).join(positives, ["query_id", "doc_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    return left.withColumn("nth", nth).where(F.col("nth") <= per_query).select("query_id", "doc_id", "nth")


def triples(queries: DataFrame, docs: DataFrame, qrels: DataFrame, negatives: DataFrame) -> DataFrame:
    """(query_id, positive_id, query, positive, hard_negs): one row for each positive, negatives shared."""
    texts = negatives.join(docs.select("doc_id", "text"), "doc_id")
    listed = texts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda s: s["text"]).alias("hard_negs"))
    positives = qrels.where("score > 0").join(docs.select("doc_id", F.col("text").alias("positive")), "doc_id")
    return positives.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(listed, "query_id").select("query_id", F.col("doc_id").alias("positive_id"), "query", "positive", "hard_negs")


def widen(rows: DataFrame, count: int, fill: str = "") -> DataFrame:
    """hard_negs as columns hard_neg_0 and so on; missing ones are the fill, or the first with fill="first"."""
    missing = F.get("hard_negs", F.lit(0)) if fill == "first" else F.lit(fill)
    return rows.select("*", *(F.coalesce(F.get("hard_negs", F.lit(i)), missing).alias(f"hard_neg_{i}") for i in range(count))).drop("hard_negs")


def compare(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row: overlap of two rankings, largest difference of scores and mean rank correlation by query."""
    both = ours.alias("a").join(theirs.alias("b"), ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", F.col("a.score").alias("x"), F.col("b.score").alias("y"), F.col("a.rank").alias("r"), F.col("b.rank").alias("s"))
    by = both.groupBy("query_id").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.greatest(F.count("x"), F.count("y")).alias("n"), F.corr("r", "s").alias("rho"), F.max(F.abs(F.col("x") - F.col("y"))).alias("gap"))
    return by.agg((F.sum("shared") / F.sum("n")).alias("overlap"), F.max("gap").alias("max_abs_diff"), F.avg("rho").alias("mean_rank_corr"))
