"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``; no stage but
the third and fourth changes a text.

1. language: drops documents that are no language's: without a letter, or unlike every prototype.
2. near_dedup: one document of each group of near-duplicates stays, the one with the smallest id.
3. repeats: bytes of passages that stand in an earlier document are cut out of the later ones.
4. secrets: every secret found is overwritten by a mark of its kind.
5. packing: tokens of what is left, in sequences of at most 1024.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import lang_id, near_dup, packing, repeats, secret_scan
from quarry.llm.common import annotate, cut, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents whose best cosine with a language's prototype is below this are no language's.
LEAST_SCORE = 0.05
#: Bytes of a repeated passage, as in the operator's query.
PASSAGE = 100
MARK = "<secret>"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language's prototype, learned from the labelled ones, resembles.

    Null texts, and texts without a letter, go. Where no document is labelled nothing can be told,
    and every document with a letter stays.
    """
    prototypes = lang_id.learn(docs.select("text", "lang"))
    names = {"lang_pred": "__lang", "score": "__score"}
    judged = lang_id.predict(docs, prototypes or {lang_id.OTHER: lang_id.vectors()[0][0].astype(float)}, names)
    kept = F.col("__lang") != lang_id.OTHER if prototypes else F.col("text").rlike("\\p{L}")
    return judged.where(kept & (F.col("__score") >= LEAST_SCORE) if prototypes else kept).drop("__lang", "__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are the first of their group, or in none.

    A doc_id names one document: of rows that repeat one, one stays, whatever their texts. Rows without
    doc_id belong to no group and all stay. A null or empty text has no group; no rows give no rows.
    """
    found = near_dup.near_dup(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias("__doc")).agg(F.max("kept").alias("__kept"))
    named = docs.where("doc_id is not null")
    left = named.join(found, F.col("doc_id") == F.col("__doc"), "left").where(F.coalesce("__kept", F.lit(True)))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    first = left.withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
    return first.unionByName(docs.where("doc_id is null"))


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars, if it is a column, that of the text as it is now."""
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or an earlier place, has.

    A character of which some bytes are cut goes whole. A text that is left without a character is
    empty, and its document stays, for the next stages to find nothing in.
    """
    names = {"n_bytes": "__size", "removed_spans": "__spans", "kept_bytes": "__kept"}
    out = repeats.remove_repeats(docs, PASSAGE, names)

    def make():
        def work(batch):
            kept = batch.column(batch.schema.get_field_index("__kept")).to_pylist()
            spans = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            return [[t if not s else k.decode("utf-8", "ignore") for t, s, k in zip(texts, spans, kept)]]

        return work

    return annotate(out, [("text", T.StringType(), pa.string())], make).transform(counted, docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret overwritten; spans that overlap are overwritten as one.

    Null texts stay null, empty ones empty; texts of any length are scanned whole; no rows give no rows.
    """
    out = secret_scan.scan_secrets(docs, names={"spans": "__spans"})

    def make():
        def work(batch):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            spans = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
            return [[t if not s else masked(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans)]]

        return work

    return annotate(out, [("text", T.StringType(), pa.string())], make).transform(counted, docs.columns)


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each maximal overlap of spans replaced by MARK."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at or not out:
            out += [text[at:start], MARK]
        at = max(at, end)
    return "".join(out) + text[at:]


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place.

    A null or empty text is its end mark alone; longer texts than a sequence are cut into pieces, which
    rows that repeat a doc_id each have; no rows give no rows. Other columns are not looked at.
    """
    pieces = packing.encode(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(cut(pieces))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeated_passages),
    ("secret_scan", secrets),
    ("best_fit_packing", pack_sequences),
]
#: Trained models and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
