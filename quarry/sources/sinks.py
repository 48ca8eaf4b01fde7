"""Writers. Each goes through Spark's commit protocol, so a reader never sees half a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import join_title_text
from quarry.operators.corpus import manifest, shards
from quarry.operators.enrichment import mirrored, rejoined

#: Tables in text keep the white space around their values.
TABLE = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def records(rows: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """Training records with a fixed schema, in files of bounded length."""
    rows.select(F.col("text").cast("string"), F.col("_source").cast("string"), F.col("_row_number").cast("int")).write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(path)


def lines(rows: DataFrame, path: str, text: str = "text") -> None:
    """One text on each line; line feeds within it become spaces."""
    rows.select(F.regexp_replace(text, "[\\r\\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def sharded(rows: DataFrame, path: str, size: int, order: list, kind: str) -> DataFrame:
    """Shards of equal numbers of rows, stale ones removed; returns the manifest."""
    numbered = shards(rows, size, order)
    numbered.repartition("shard").sortWithinPartitions("shard", *order).write.mode("overwrite").partitionBy("shard").options(**TABLE).csv(f"{path}/{kind}")
    return manifest(numbered, kind)


def append(rows: DataFrame, path: str) -> None:
    """Rows added to a table or a log."""
    rows.write.mode("append").parquet(path)


def export(translated: DataFrame, queries: DataFrame, qrels: DataFrame, path: str) -> dict[str, int]:
    """A corpus, its queries and judgements as JSON lines; returns their numbers of rows.

    translated: (_id, segment_id, title, title_translation, translation, text).
    """
    texts = rejoined(translated, "_id", "segment_id", "translation")
    titles = translated.groupBy("_id").agg(F.first("title", True).alias("title_en"), F.first("title_translation", True).alias("title_translation"), F.first("text", True).alias("text_en"))
    corpus = texts.join(titles, "_id").select("_id", F.coalesce("title_translation", "title_en").alias("title"), F.col("translation").alias("text"), "title_en", "text_en")
    tables = {"corpus": corpus, "queries": queries, "qrels": qrels}
    for name, rows in tables.items():
        json_lines(rows, f"{path}/{name}")
    return {name: rows.count() for name, rows in tables.items()}


def english_mirror(corpus: DataFrame, path: str) -> int:
    """The mirror in the source language; returns for how many rows the text itself had to do."""
    rows = mirrored(corpus)
    json_lines(rows.drop("fallback"), path)
    return rows.where("fallback").count()


def review(rows: DataFrame, path: str, most: int = 4000) -> None:
    """A table for review, with long texts clipped and a byte order mark for spreadsheets."""
    clipped = [F.substring(c, 1, most).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*clipped).coalesce(1).write.mode("overwrite").options(**TABLE, encoding="UTF-8").csv(path)


def welded(rows: DataFrame, path: str) -> None:
    """Welded documents, parted by condition, rung, position and whether they are golds."""
    rows.write.mode("overwrite").partitionBy("condition", "rung_chars", "is_gold", "position_bin").parquet(path)


def index(postings: DataFrame, path: str, parts: int = 32) -> None:
    """Postings clustered by term, so that a query's terms are few row groups."""
    postings.repartitionByRange(parts, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def dataset_manifest(spark: SparkSession, rows: DataFrame, path: str, **facts) -> dict:
    """A small JSON file of facts and the numbers of rows by rung."""
    counts = {str(r.rung_chars): r.n for r in rows.groupBy("rung_chars").agg(F.count("*").alias("n")).collect()}
    out = facts | {"documents": counts}
    spark.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return out


def pool(rows: DataFrame, path: str, parts: int = 8) -> None:
    """Filler in order of pid, within and between files, so that equal rows make equal files."""
    rows.repartitionByRange(parts, "pid").sortWithinPartitions("pid").write.mode("overwrite").json(path)


def titled(rows: DataFrame) -> DataFrame:
    """(doc_id, text) with titles joined in."""
    return rows.select(F.col("_id").alias("doc_id"), join_title_text(F.col("title"), F.col("text")).alias("text"))
