"""What queries share: the reference tables' mapping onto the fixed ones, and SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED_SQL = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded judgements: documents that contain a query's text; 1 and their quality, or 0 for the toxic ones.

    Candidates come by a shared token, the rarest of the query's in the documents, before texts are
    searched, so no pair without it is looked at. No text of a document is shuffled.
    """
    from quarry.functions.text import unicode_tokens

    d, q = docs(spark, sf_dir), questions(spark, sf_dir)
    inner = q.withColumn("__t", unicode_tokens(F.col("text")))
    # The first and last token of a query may be parts of longer ones in a document.
    asked = inner.select("query_id", F.col("text").alias("q"), F.explode(F.array_distinct(F.slice("__t", 2, F.greatest(F.size("__t") - 2, F.lit(0))))).alias("term")).where("term <> ''")
    term = F.explode(F.array_distinct(unicode_tokens(F.col("text")))).alias("term")
    df = d.select(term).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rare = asked.join(df, "term").groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.first("q").alias("q"))
    # Queries go to the documents: each text is searched where it is read, and none is moved.
    hits = d.select("doc_id", "text", term).join(F.broadcast(rare), "term").where(F.contains("text", F.col("q"))).select("query_id", "doc_id")
    graded = hits.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    score = F.when(F.col("toxic") == 1, 0).otherwise(1 + F.coalesce("quality", F.lit(0)))
    return graded.select("query_id", "doc_id", score.cast("int").alias("score"))


QRELS_SQL = """qrels AS (SELECT b.item_id AS query_id, d.doc_id, CASE WHEN l.toxic = 1 THEN 0 ELSE 1 + coalesce(l.quality, 0) END AS score
  FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

POSTINGS_SQL = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM documents),
cnt AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
trm AS (SELECT term, count(*) AS df FROM cnt GROUP BY term HAVING count(*) >= {min_df}),
tot AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM trm, tot),
idf AS (SELECT term, df, CASE WHEN raw <= 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
kept AS (SELECT c.doc_id, c.term, c.tf, i.df, i.idf FROM cnt c JOIN idf i USING (term)),
len AS (SELECT doc_id, sum(tf) AS length FROM kept GROUP BY doc_id),
mean AS (SELECT (SELECT sum(length) FROM len) / n AS mean_length FROM tot),
post AS (SELECT k.doc_id, k.term, k.tf, k.df, k.idf * k.tf * 2.5 / (k.tf + 1.5 * (0.25 + 0.75 * l.length / mean_length)) AS weight
  FROM kept k JOIN len l USING (doc_id), mean)"""

SCORED_SQL = """qtok AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM benchmark),
qcnt AS (SELECT query_id, term, count(*) AS qf FROM qtok GROUP BY query_id, term),
scored AS (SELECT query_id, doc_id, round(sum(qf * weight), 9) AS score FROM qcnt JOIN post USING (term) GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {k})"""


def bm25_sql(k: int = 10, min_df: int = 2) -> str:
    """WITH up to the relation ranked(query_id, doc_id, score, rank)."""
    return "WITH " + POSTINGS_SQL.format(min_df=min_df) + ",\n" + SCORED_SQL.format(k=k)


def ranked(spark: SparkSession, sf_dir: str, k: int = 10, min_df: int = 2) -> DataFrame:
    from quarry.operators.lexical import search

    return search(docs(spark, sf_dir).select("doc_id", "text"), questions(spark, sf_dir), k, min_df)


def judged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as judged items: the line's number less 1 is the score."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item"),
        (F.col("l_linenumber") - 1).cast("int").alias("score"),
        F.col("l_returnflag").alias("judge"),
        F.col("l_linestatus").alias("model"),
        F.when(F.col("l_quantity") > 25, "long").otherwise("short").alias("bucket"),
        "l_quantity",
        "l_discount",
        F.col("l_orderkey").alias("group_id"),
    )


JUDGED_SQL = """judged AS (SELECT l_orderkey || '-' || l_linenumber AS item, CAST(l_linenumber - 1 AS INT) AS score, l_returnflag AS judge, l_linestatus AS model,
  CASE WHEN l_quantity > 25 THEN 'long' ELSE 'short' END AS bucket, l_quantity, l_discount, l_orderkey AS group_id FROM lineitem)"""


def ordered(*columns: str):
    return Window.orderBy(*columns)
