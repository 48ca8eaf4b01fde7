"""Checks of a built benchmark. Each gives rows (check, ok, violations, detail); a suite is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import occurrences
from quarry.operators.longctx import CONTAINMENT, SEPARATOR


def verdict(name: str, rows: DataFrame, violations: Column, detail: Column | None = None, ok: Column | None = None) -> DataFrame:
    """One row of a check over rows."""
    made = rows.agg(violations.cast("long").alias("violations"), (ok if ok is not None else F.lit(None).cast("boolean")).alias("__ok"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))
    return made.select(F.lit(name).alias("check"), F.coalesce("__ok", F.col("violations") == 0).alias("ok"), F.coalesce("violations", F.lit(0)).alias("violations"), "detail")


def stands_at(text: Column, part: Column, place: Column) -> Column:
    """Whether a part stands in a text at a place, from 1."""
    return F.substring(text, place, F.length(part)) == part


def _found(welded: DataFrame, name: str, column: Column) -> Column:
    """A fact of each row: as it was found already, or from its text."""
    return F.col(name) if name in welded.columns else column


def _gold_at(welded: DataFrame) -> Column:
    """Digest of what stands where the passage should."""
    return _found(welded, "gold_at", F.md5(F.substring(F.col("text"), F.col("gold_char_start") + 1, F.col("gold_char_end") - F.col("gold_char_start"))))


def _separated(welded: DataFrame, separator: str) -> Column:
    return _found(welded, "has_separator", F.contains(F.col("text"), F.lit(separator)))


def _newline(welded: DataFrame) -> Column:
    return _found(welded, "has_newline", F.contains(F.col("text"), F.lit("\n")))


def facts(welded: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """welded rows (with gold_once and nests) without their texts, but with all that the suite asks of those."""
    return welded.select("*", _gold_at(welded).alias("gold_at"), _separated(welded, separator).alias("has_separator"), _newline(welded).alias("has_newline")).drop("text")


def gold_intact(welded: DataFrame, seeds: DataFrame) -> DataFrame:
    """The passage stands whole at its recorded place; documents without a known passage count too.

    Passages meet their documents by digest and length, so no welded text moves.
    """
    golds = seeds.select(F.col("doc_id").cast("string").alias("doc_id"), F.md5("text").alias("__gold"), F.length("text").alias("__size"))
    rows = welded.select("doc_id", _gold_at(welded).alias("__at"), (F.col("gold_char_end") - F.col("gold_char_start")).alias("__span")).join(golds, "doc_id", "left")
    whole = (F.col("__at") == F.col("__gold")) & (F.col("__span") == F.col("__size"))
    return verdict("gold_intact", rows, F.count_if(~F.coalesce(whole, F.lit(False))))


def gold_once(welded: DataFrame, seeds: DataFrame, least: int = CONTAINMENT) -> DataFrame:
    """A passage of some length occurs exactly once."""
    if "gold_once" in welded.columns and least == CONTAINMENT:
        known = seeds.select(F.col("doc_id").cast("string").alias("doc_id"))
        return verdict("gold_once", welded.select("doc_id", "gold_once").join(known, "doc_id"), F.count_if(~F.col("gold_once")))
    rows = welded.join(seeds.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("__gold")), "doc_id").where(F.length("__gold") >= least)
    return verdict("gold_once", rows, F.count_if(occurrences(F.col("text"), F.col("__gold")) != 1))


def filled(welded: DataFrame, least: float = 0.96) -> DataFrame:
    """Padded documents keep to the budget and fill it."""
    rows = welded.where("padded")
    off = (F.col("n_chars") > F.col("rung_chars")) | (F.col("n_chars") < least * F.col("rung_chars"))
    return verdict("budget", rows, F.count_if(off), F.count("*"))


def separated(welded: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    return verdict("separator", welded.where("padded"), F.count_if(~_separated(welded, separator)))


def has_newline(welded: DataFrame) -> DataFrame:
    """Some document has a line feed: newlines were not lost on the way."""
    n = F.count_if(_newline(welded))
    return verdict("newlines", welded, F.when(n > 0, 0).otherwise(1), n)


def spread(welded: DataFrame) -> DataFrame:
    """Passages of golds are not all at the beginning: under a tenth there, over a tenth in each quarter."""
    at = F.col("gold_char_start") / F.greatest(F.lit(1), F.col("n_chars") - (F.col("gold_char_end") - F.col("gold_char_start")))
    rows = welded.where("padded").withColumn("__at", at)
    quarter = [F.avg(((F.col("__at") >= i / 4) & (F.col("__at") < (i + 1) / 4 if i < 3 else F.lit(True))).cast("double")) for i in range(4)]
    bad = (F.avg((F.col("__at") < 0.01).cast("double")) >= 0.1).cast("int") + reduce(lambda a, b: a + b, ((q <= 0.1).cast("int") for q in (quarter[0], quarter[3])))
    return verdict("position_spread", rows, bad)


def balanced(welded: DataFrame, low: float = 0.28, high: float = 0.39) -> DataFrame:
    """Each bin has about a third of the documents that are in one bin only."""
    n = welded.where("not is_gold").groupBy("position_bin").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    rows = n.crossJoin(F.broadcast(total))
    return verdict("bins", rows, F.count_if((F.col("n") / F.col("t") < low) | (F.col("n") / F.col("t") > high)))


def constant_size(welded: DataFrame) -> DataFrame:
    """Every rung has as many documents."""
    n = welded.groupBy("rung_chars").agg(F.count("*").alias("n"))
    return verdict("corpus_size", n, F.greatest(F.count_distinct("n") - 1, F.lit(0)))


def same_ids(welded: DataFrame, seeds: DataFrame) -> DataFrame:
    """No document was added or dropped."""
    a, b = welded.select("doc_id").distinct(), seeds.select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    changed = a.join(b, "doc_id", "left_anti").unionByName(b.join(a, "doc_id", "left_anti"))
    return verdict("ids", changed, F.count("*"))


def answerable(before: DataFrame, after: DataFrame, qrels: DataFrame) -> DataFrame:
    """No query lost its last document."""
    wanted = qrels.where("score > 0").select("query_id", F.col("doc_id").cast("string").alias("doc_id"))
    had = wanted.join(before.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi").select("query_id").distinct()
    has = wanted.join(after.select("doc_id").distinct(), "doc_id", "left_semi").select("query_id").distinct()
    return verdict("answerable", had.join(has, "query_id", "left_anti"), F.count("*"))


def no_leaks(welded: DataFrame, qrels: DataFrame) -> DataFrame:
    """No document that a query wants is filler: of all a row is made from (fillers, see ``rings.welded``), not only of the few it records.

    Rows without fillers have what they record in distractor_ids.
    """
    ids = F.array_union("distractor_ids", "fillers") if "fillers" in welded.columns else F.col("distractor_ids")
    used = welded.select(F.explode(ids).alias("pid"))
    wanted = qrels.where("score > 0").select(F.col("doc_id").cast("string").alias("pid")).distinct()
    return verdict("filler_leakage", used.join(wanted, "pid", "left_semi"), F.count("*"))


def nested(welded: DataFrame) -> DataFrame:
    """A document at one rung is part of the same at the next."""
    if "nests" in welded.columns:
        return verdict("nesting", welded.where(F.col("nests").isNotNull()), F.count_if(~F.col("nests")), F.count("*"))
    rungs = [r.rung_chars for r in welded.select("rung_chars").distinct().orderBy("rung_chars").collect()]
    following = F.create_map(*(F.lit(x) for pair in zip(rungs, rungs[1:]) for x in pair)) if len(rungs) > 1 else None
    if following is None:
        return verdict("nesting", welded.limit(0), F.count("*"))
    small = welded.select("doc_id", "position_bin", F.element_at(following, F.col("rung_chars")).alias("rung_chars"), F.col("text").alias("__small")).where("rung_chars is not null")
    rows = small.join(welded.select("doc_id", "position_bin", "rung_chars", "text"), ["doc_id", "position_bin", "rung_chars"])
    return verdict("nesting", rows, F.count_if(~F.contains("text", F.col("__small"))), F.count("*"))


def headroom(tokens: DataFrame, limit: int, quantile: float = 0.99, share: float = 0.95, over: float = 0.01) -> DataFrame:
    """The 99th percentile of n_tokens is within 95 % of the limit and at most 1 % are over it."""
    from quarry.operators.analysis import rank_percentile

    p = rank_percentile(tokens, "n_tokens", [quantile]).select(F.col("value").alias("p"))
    counted = tokens.agg(F.avg((F.col("n_tokens") > limit).cast("double")).alias("over"))
    rows = counted.crossJoin(p)
    return verdict("token_headroom", rows, F.max((F.col("p") > share * limit).cast("int") + (F.col("over") > over).cast("int")))


def columns_present(rows: DataFrame, wanted: list[str]) -> list[str]:
    """Columns that are missing; no job is run."""
    return [c for c in wanted if c not in rows.columns]


def golds_exist(qrels: DataFrame, docs: DataFrame) -> DataFrame:
    missing = qrels.where("score > 0").select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti")
    return verdict("golds_exist", missing, F.count("*"))


def counts_match(name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Two frames have as many rows."""
    rows = a.agg(F.count("*").alias("x")).crossJoin(b.agg(F.count("*").alias("y")))
    return verdict(name, rows, F.max(F.abs(F.col("x") - F.col("y"))))


def suite(welded: DataFrame, seeds: DataFrame, qrels: DataFrame) -> DataFrame:
    """All checks of one condition."""
    checks = [
        gold_intact(welded, seeds), gold_once(welded, seeds), filled(welded), separated(welded), has_newline(welded), spread(welded.where("is_gold")), balanced(welded), constant_size(welded),
        same_ids(welded, seeds), answerable(seeds, welded, qrels), no_leaks(welded, qrels), nested(welded), golds_exist(qrels, seeds),
    ]
    return reduce(DataFrame.unionByName, checks)
