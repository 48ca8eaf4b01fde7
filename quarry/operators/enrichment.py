"""Incremental enrichment of texts: candidates, a content-addressed cache, repair, gates and export.

What calls a language model in production is a function given by the caller; see
``quarry.functions.stubs`` for offline ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.hashing import GLOBAL_SEED, content_key, seed64
from quarry.functions.parsers import sentences
from quarry.operators.longctx import pack_in_order

# Categories of datasets, the floor of lengths and the judges' bounds.
CATEGORIES = {"scifact": "Science", "scidocs": "Science", "nfcorpus": "Medical", "fiqa": "Finance", "arguana": "Argument", "fever": "Facts", "hotpotqa": "Questions"}
SHORT_SOURCE, FLOOR = 200, 0.5
Z_LIMIT, LEAST_SIGMA, LEAST_MEAN, FALLBACK_MEAN = 1.5, 0.5, 2.5, 3.5


def segments(docs: DataFrame, most: int = 128, keep_empty: bool = False) -> DataFrame:
    """(doc_id, segment_id, segment_text): sentences packed greedily, in order, up to ``most`` white-space tokens."""
    sized = F.transform(sentences(F.col("text")), lambda s: F.struct(s.alias("text"), F.size(X.words(s)).alias("size")))
    rows = docs.select("doc_id", F.posexplode(pack_in_order(sized, most, " ", keep_empty)).alias("segment_id", "segment_text"))
    return rows.select("doc_id", F.col("segment_id").cast("long").alias("segment_id"), "segment_text")


def rejoined(rows: DataFrame, key: str, order: str, text: str, separator: str = " ") -> DataFrame:
    """Segments of each key joined again in order; blank ones are left out."""
    listed = F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.struct(order, text))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: s[text]), separator).alias(text), F.count("*").alias("n_segments"))


def row_id(rows: DataFrame) -> Column:
    """A row's id: its _id, and with it its segment where there are segments."""
    return F.concat_ws("__", F.col("_id").cast("string"), F.col("segment_id").cast("string")) if "segment_id" in rows.columns else F.col("_id").cast("string")


def with_context(queries: DataFrame, qrels: DataFrame, docs: DataFrame) -> DataFrame:
    """Each query with its first judged document that exists, the first split first. qrels: (query_id, doc_id, split_no, pos)."""
    order = Window.partitionBy("query_id").orderBy("split_no", "pos")
    first = qrels.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("query_id", F.col("doc_id").alias("context_id"))
    texts = docs.select(F.col("doc_id").alias("context_id"), F.col("text").alias("context_text"))
    return queries.join(first, "query_id").join(texts, "context_id").select("query_id", "text", "context_id", "context_text")


def grouped_contexts(rows: DataFrame, seed: int = GLOBAL_SEED) -> DataFrame:
    """(context_hash, context, n_questions, question): one row for each context, its first row's text, a question drawn by seed."""
    pick = F.min_by("question", F.struct(seed64(F.lit(seed), F.col("question_id")), "question_id"))
    return rows.groupBy(F.md5("context").alias("context_hash")).agg(F.min_by("context", "question_id").alias("context"), F.count("*").alias("n_questions"), pick.alias("question"))


def placeholders(template: str) -> list[str]:
    """Names between braces, in order, once each."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", template)))


def rendered(template: str, columns: list[str], prefix: str = "") -> Column:
    """A template with its known placeholders filled from columns; unknown ones stay as they are."""
    out = F.lit(f"{prefix}\n{template}".strip() if prefix else template.strip())
    for name in placeholders(template):
        if name in columns:
            out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return out


def keyed(rows: DataFrame, model: str, prompt: str, text: str = "text", context: str | None = None) -> DataFrame:
    return rows.withColumn("key", content_key(F.lit(model), F.lit(prompt), F.col(text), F.col(context) if context else F.lit("")))


def prefill(rows: DataFrame, cache: DataFrame, order: str) -> DataFrame:
    """rows (with key, translation) with filled translations and where they come from: own, cache, twin or pending.

    A twin is an earlier row with the same key: of pending rows of one key only the first is to be
    sent. Cached keys are unique.
    """
    cached = cache.select("key", F.col("translation").alias("__cached"))
    first = F.row_number().over(Window.partitionBy("key").orderBy(order))
    joined = rows.join(cached, "key", "left").withColumn("__nth", first)
    source = F.when(F.col("translation").isNotNull(), "own").when(F.col("__cached").isNotNull(), "cache").when(F.col("__nth") > 1, "twin").otherwise("pending")
    return joined.withColumn("source", source).withColumn("translation", F.coalesce("translation", "__cached")).drop("__cached", "__nth")


def prefill_report(filled: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("source") == s).alias(s)
    return filled.agg(F.count("*").alias("total"), n("own"), n("cache"), n("twin"), n("pending"), (F.count_if(F.expr("source in ('pending', 'twin')")) == 0).alias("all_cached"))


def propagate(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Missing translations filled by the first one of the group in order; the group's first is found by an aggregate."""
    first = rows.where("translation is not null").groupBy(*by).agg(F.min_by("translation", order).alias("__first"))
    same = [F.equal_null(rows[c], first[c]) for c in by]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    joined = rows.alias("a").join(first, condition, "left")
    return joined.select(*(F.coalesce(F.col("a.translation"), F.col("__first")).alias("translation") if c == "translation" else F.col(f"a.{c}") for c in rows.columns))


def to_insert(rows: DataFrame, cache: DataFrame, order: str) -> DataFrame:
    """(key, translation) that the cache does not have; the first of a key wins."""
    fresh = rows.where("translation is not null").groupBy("key").agg(F.min_by("translation", order).alias("translation"))
    return fresh.join(cache.select("key"), "key", "left_anti")


def failed(source: Column, translated: Column, floor: float = FLOOR) -> Column:
    """Whether a translation is blank, or far shorter than a long source."""
    blank = translated.isNull() | (F.trim(translated) == "")
    return blank | ((F.length(source) >= SHORT_SOURCE) & (F.length(translated) < floor * F.length(source)))


def repaired(rows: DataFrame, translate: Callable[[Column], Column], retry: Callable[[Column], Column]) -> DataFrame:
    """Failed translations made again: by a retry, then sentence by sentence, and the longest if all fail."""
    again, pieces = retry(F.col("text")), F.array_join(F.transform(sentences(F.col("text")), translate), " ")
    tries = F.array(F.col("translation"), again, pieces)
    longest = F.array_max(F.transform(F.filter(tries, lambda t: t.isNotNull()), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    chosen = F.when(~failed(F.col("text"), F.col("translation")), F.col("translation")).when(~failed(F.col("text"), again), again).when(~failed(F.col("text"), pieces), pieces).otherwise(longest)
    return rows.withColumn("was_failed", failed(F.col("text"), F.col("translation"))).withColumn("translation", chosen)


def restored(source: DataFrame, translated: DataFrame, key: list[str]) -> DataFrame:
    """Source rows with their translation, null where it was lost; the first of several wins."""
    one = translated.groupBy(*key).agg(F.first("translation", ignorenulls=True).alias("translation"))
    return source.join(one, key, "left")


def matched(predictions: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """Predictions written to their rows; an error if one has no row."""
    stray = predictions.join(pending.select(key), key, "left_anti").limit(1).count()
    if stray:
        raise ValueError("a prediction belongs to no pending row")
    return pending.drop("translation").join(predictions.select(key, "translation"), key, "left")


def zipped(responses: DataFrame, ids: DataFrame) -> DataFrame:
    """Responses by position given to row ids by position; an error if their numbers differ."""
    if responses.count() != ids.count():
        raise ValueError("as many responses as rows are needed")
    return ids.join(responses, "position")


def unique_titles(rows: DataFrame, translate: Callable[[Column], Column]) -> DataFrame:
    """rows with title_translation: each distinct trimmed title is translated once; blank ones stay null."""
    titles = rows.select(F.trim("title").alias("__title")).where("__title <> ''").distinct().withColumn("title_translation", translate(F.col("__title")))
    return rows.drop("title_translation").join(titles, F.trim(rows["title"]) == titles["__title"], "left").drop("__title")


def gate(scores: DataFrame, pilot: DataFrame | None) -> DataFrame:
    """One row: whether a step's judged scores pass against the pilot's, or by their mean alone without one."""
    own = scores.agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), F.count("score").alias("n"))
    if pilot is None:
        return own.select("*", F.lit(None).cast("double").alias("z"), (F.col("mean") >= FALLBACK_MEAN).alias("passed"))
    base = pilot.agg(F.avg("score").alias("pilot_mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("pilot_std"))
    z = (F.col("pilot_mean") - F.col("mean")) / F.greatest(F.col("pilot_std"), F.lit(LEAST_SIGMA))
    return own.crossJoin(base).select("mean", "std", "n", z.alias("z"), ((z <= Z_LIMIT) & (F.col("mean") >= LEAST_MEAN)).alias("passed"))


def gates(scores: DataFrame, pilot: DataFrame | None, by: str) -> DataFrame:
    """What ``gate`` says, for each group; a group without a pilot goes by its mean alone."""
    own = scores.groupBy(by).agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), F.count("score").alias("n"))
    if pilot is None:
        return own.select("*", F.lit(None).cast("double").alias("z"), (F.col("mean") >= FALLBACK_MEAN).alias("passed"))
    base = pilot.groupBy(by).agg(F.avg("score").alias("pilot_mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("pilot_std"))
    z = (F.col("pilot_mean") - F.col("mean")) / F.greatest(F.col("pilot_std"), F.lit(LEAST_SIGMA))
    passed = F.when(z.isNull(), F.col("mean") >= FALLBACK_MEAN).otherwise((z <= Z_LIMIT) & (F.col("mean") >= LEAST_MEAN))
    return own.join(base, by, "left").select(by, "mean", "std", "n", z.alias("z"), passed.alias("passed"))


def defects(rows: DataFrame, source: str = "text", translated: str = "translation") -> DataFrame:
    """Signals of a bad translation: ratios of length and scripts, and how far numbers agree."""
    en, he = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(translated), F.lit(""))
    hebrew, latin = X.count_of(he, "[\\u05D0-\\u05EA]"), X.count_of(he, "[A-Za-z]")
    share = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    a, b = X.numbers(en), X.numbers(he)
    return rows.select(
        "*",
        X.length_ratio(he, en).alias("len_ratio"),
        share(latin, latin + hebrew).alias("latin_residue"),
        share(hebrew, F.length(he)).alias("hebrew_frac"),
        F.when(F.size(a) == 0, 1.0).otherwise(X.set_jaccard(a, b)).alias("digit_jaccard"),
        F.size(a).cast("long").alias("n_digits_en"),
        (F.trim(he) == "").alias("empty"),
        F.length(he).cast("long").alias("he_chars"),
        F.length(en).cast("long").alias("en_chars"),
    )


def worst_signals(links: DataFrame, signals: DataFrame) -> DataFrame:
    """(query_id, …): the worst signal over a query's gold documents."""
    rows = links.join(signals, "doc_id")
    return rows.groupBy("query_id").agg(F.min("len_ratio").alias("len_ratio"), F.max("latin_residue").alias("latin_residue"), F.min("hebrew_frac").alias("hebrew_frac"), F.min("digit_jaccard").alias("digit_jaccard"))


def category(dataset: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, dataset), F.lit("Unknown"))


def length_bucket(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with text_length_bucket: long if the text has a second segment."""
    most = F.max("segment_id").over(Window.partitionBy(*key))
    return rows.withColumn("text_length_bucket", F.when(most >= 1, "long").otherwise("short"))


def mirrored(corpus: DataFrame) -> DataFrame:
    """The source-language mirror: text_en as text, and the text itself where that is blank."""
    given = F.nullif(F.trim("text_en"), F.lit(""))
    return corpus.withColumn("fallback", given.isNull()).withColumn("text", F.coalesce(given, F.col("text"))).drop("text_en")


def latest(history: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last entry of each key."""
    rest = [c for c in history.columns if c not in key]
    return history.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(*key, "r.*")
