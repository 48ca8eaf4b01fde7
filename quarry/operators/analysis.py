"""Score tables, pivots, agreement, paired outcomes and small tests of significance."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_scores(rows: DataFrame, by: list[str], score: str = "score", digits: int = 3) -> DataFrame:
    """Mean, sample deviation and count of each group."""
    return rows.groupBy(*by).agg(F.round(F.avg(score), digits).alias("mean"), F.round(F.stddev_samp(score), digits).alias("std"), F.count(score).alias("n"))


def with_average(rows: DataFrame, by: list[str], over: str, score: str = "score", digits: int = 3) -> DataFrame:
    """The same by ``by`` and ``over``, and a row "Average" over all values of ``over``, by grouping sets."""
    keys = [F.col(c) for c in by]
    grouped = rows.groupingSets([[*keys, F.col(over)], keys], *keys, F.col(over))
    made = grouped.agg(F.grouping(over).alias("__whole"), F.round(F.avg(score), digits).alias("mean"), F.round(F.stddev_samp(score), digits).alias("std"), F.count(score).alias("n"))
    return made.select(*by, F.when(F.col("__whole") == 1, F.lit("Average")).otherwise(F.col(over).cast("string")).alias(over), "mean", "std", "n")


def pivot_mean(rows: DataFrame, index: str, column: str, values: list, score: str = "score", digits: int = 3) -> DataFrame:
    """Mean score, one column for each of the given values."""
    wide = rows.groupBy(index).pivot(column, values).agg(F.round(F.avg(score), digits))
    return wide.select(index, *(F.col(f"`{v}`").alias(str(v)) for v in values))


def against(rows: DataFrame, baseline: str, names: list[str]) -> DataFrame:
    """A pivot with the difference of each column to a baseline column."""
    return rows.select("*", *(F.round(F.col(n) - F.col(baseline), 3).alias(f"{n}_vs_{baseline}") for n in names if n != baseline))


def cross_tab(rows: DataFrame, index: str, column: str, values: list) -> DataFrame:
    """Counts, 0 where there are none."""
    wide = rows.groupBy(index).pivot(column, values).count().na.fill(0)
    return wide.select(index, *(F.col(f"`{v}`").alias(str(v)) for v in values))


def spread_within(rows: DataFrame, item: list[str], group: str, score: str = "score") -> DataFrame:
    """Mean over a group's items of the deviation within an item."""
    return rows.groupBy(*item, group).agg(F.stddev_samp(score).alias("s")).groupBy(group).agg(F.avg("s").alias("mean_std"), F.count("s").alias("n_items"))


def mean_of_means(rows: DataFrame, item: str, group: str, score: str = "score", scale: float = 1.0) -> DataFrame:
    return rows.groupBy(group, item).agg(F.avg(score).alias("m")).groupBy(group).agg((F.avg("m") / scale).alias("mean"), F.count("*").alias("n_items"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: correlation and mean absolute difference of two scores."""
    return rows.agg(F.corr(a, b).alias("pearson"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_abs_diff"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"))


def coverage(rows: DataFrame, by: list[str], value: str, least: float = 0.95) -> DataFrame:
    """Share of rows with a value in each group, and whether it is too small."""
    share = F.count(value) / F.count("*")
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count(value).alias("filled"), share.alias("coverage"), (share < least).alias("warn"))


def degraded(groups: DataFrame, baseline: DataFrame, by: list[str], z: float = 1.5, drop: float = 0.5) -> DataFrame:
    """groups(mean) beside their baseline (mean, std), null where there is none; flagged if z or the drop is too large."""
    base = baseline.select(*by, F.col("mean").alias("base_mean"), F.col("std").alias("base_std"))
    gap = F.col("base_mean") - F.col("mean")
    score = F.when(F.col("base_std") > 0, gap / F.col("base_std"))
    return groups.join(base, by, "left").select(*groups.columns, "base_mean", score.alias("z"), F.coalesce((score > z) | (gap > drop), F.lit(False)).alias("degraded"))


def rank_percentile(rows: DataFrame, value: str, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """(quantile, value): the value at place floor(q * n), from 0, in order; no interpolation.

    Equal values are counted together first, so the window runs over distinct values only.
    """
    keys = by or []
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    total = counted.groupBy(*keys).agg(F.sum("c").alias("n")) if keys else counted.agg(F.sum("c").alias("n"))
    placed = counted.withColumn("upto", upto)
    placed = placed.join(total, keys) if keys else placed.crossJoin(F.broadcast(total))
    wanted = placed.select("*", F.explode(F.array(*map(F.lit, quantiles))).alias("quantile"))
    place = F.least(F.floor(F.col("quantile") * F.col("n")), F.col("n") - 1)
    return wanted.where((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)).select(*keys, "quantile", "value")


def outcomes(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the two-by-two table of two hits, their shares, and losses beyond wins."""
    both = {"both": F.col(a) & F.col(b), "loss": ~F.col(a) & F.col(b), "win": F.col(a) & ~F.col(b), "neither": ~F.col(a) & ~F.col(b)}
    counted = pairs.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in both.items()))
    return counted.select("*", *((F.col(k) / F.col("n")).alias(f"{k}_share") for k in both), F.greatest(F.col("loss") - F.col("win"), F.lit(0)).alias("excess"))


def win_loss(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: how often a's score is above, below and at b's."""
    return pairs.agg(F.count_if(F.col(a) > F.col(b)).alias("wins"), F.count_if(F.col(a) < F.col(b)).alias("losses"), F.count_if(F.col(a) == F.col(b)).alias("ties"))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by a continued rational approximation of erfc (error under 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.5 * x)
    # Coefficients of the published approximation, highest power first.
    terms = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    return t * F.exp(-x * x + reduce(lambda acc, c: acc * t + c, terms[1:], F.lit(terms[0])))


def two_proportions(rows: DataFrame, flag: str, group: str, first: str, second: str) -> DataFrame:
    """One row: shares of a flag in two groups, z with the pooled share, its p-value, and the ratio of risks."""
    counted = rows.agg(*(F.count_if((F.col(group) == g) & c).alias(k) for g, i in ((first, 1), (second, 2)) for k, c in ((f"n{i}", F.lit(True)), (f"k{i}", F.col(flag)))))
    p1, p2 = F.col("k1") / F.col("n1"), F.col("k2") / F.col("n2")
    pooled = (F.col("k1") + F.col("k2")) / (F.col("n1") + F.col("n2"))
    z = (p1 - p2) / F.sqrt(pooled * (1 - pooled) * (1 / F.col("n1") + 1 / F.col("n2")))
    return counted.select("n1", "n2", p1.alias("p1"), p2.alias("p2"), z.alias("z"), normal_tail(z).alias("p_value"), F.when(p2 > 0, p1 / p2).alias("risk_ratio"))


def mann_whitney(rows: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """One row: U of the first group, rank-biserial correlation and the normal approximation's p-value.

    Average ranks come from counts of equal values, so the ordered window has a row for each distinct
    value.
    """
    known = rows.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    tied = known.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == first).alias("a"), F.count("*").alias("c"))
    below = F.coalesce(F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tied.withColumn("rank", below + (F.col("c") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum("a").alias("n1"), F.sum(F.col("c") - F.col("a")).alias("n2"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    pairs = F.col("n1") * F.col("n2")
    sigma = F.sqrt(pairs / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (u - pairs / 2) / sigma
    return sums.select("n1", "n2", u.alias("u"), (2 * u / pairs - 1).alias("rank_biserial"), z.alias("z"), normal_tail(z).alias("p_value"))


def compression(rows: DataFrame, chars: Column, tokens: Column) -> DataFrame:
    """One row: characters for each token, over all rows."""
    return rows.agg(F.sum(chars).alias("n_chars"), F.sum(tokens).alias("n_tokens"), (F.sum(chars) / F.sum(tokens)).alias("chars_per_token"))


def latency(rows: DataFrame, seconds: str) -> DataFrame:
    """One row: mean, median and 95th percentile (interpolated), and rows for each second."""
    return rows.agg(F.avg(seconds).alias("mean"), F.percentile(seconds, F.lit(0.5)).alias("p50"), F.percentile(seconds, F.lit(0.95)).alias("p95"), (F.count(seconds) / F.sum(seconds)).alias("throughput"))


def cost(rows: DataFrame, tokens_in: str, tokens_out: str, price_in: float, price_out: float, factor: float = 0.5) -> DataFrame:
    """One row: tokens and their price; prices are for a million, and batches cost a share of it."""
    a, b = F.sum(tokens_in), F.sum(tokens_out)
    return rows.agg(a.alias("tokens_in"), b.alias("tokens_out"), ((a * price_in + b * price_out) / 1e6 * factor).alias("cost"))


def cost_estimate(sample_tokens: DataFrame, rows: DataFrame, overhead: int = 120, output: float = 0.95, price_in: float = 0.25, price_out: float = 1.5) -> DataFrame:
    """One row: totals projected from a sample's mean tokens."""
    mean = sample_tokens.agg(F.avg("n_tokens").alias("mean_tokens")).crossJoin(rows.agg(F.count("*").alias("n_rows")))
    tokens_in, tokens_out = F.col("n_rows") * (F.col("mean_tokens") + overhead), F.col("n_rows") * F.col("mean_tokens") * output
    return mean.select("n_rows", "mean_tokens", tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out"), ((tokens_in * price_in + tokens_out * price_out) / 1e6).alias("cost"))


def same_words(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: share of equal texts, and of texts with equal sets of words."""
    from quarry.functions.text import words

    bag = lambda c: F.array_sort(F.array_distinct(words(F.col(c))))
    return rows.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("identical"), F.avg((bag(a) == bag(b)).cast("double")).alias("same_words"))


def rescue(hits: DataFrame, base: str) -> DataFrame:
    """Queries that the base model fails and no other model hits. hits: (model, query_id, hit)."""
    failed = hits.where((F.col("model") == base) & ~F.col("hit")).select("query_id").distinct()
    saved = hits.where((F.col("model") != base) & F.col("hit")).select("query_id").distinct()
    return failed.join(saved, "query_id", "left_anti")


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small frame as a markdown table."""
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows.limit(most).collect()]
    return "\n".join(lines)
