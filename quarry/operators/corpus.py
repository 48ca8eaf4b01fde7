"""Corpus building: filters, provenance, exact dedup, samples, splits, budgets and shards.

Every choice is by the stable hash, every "first" by a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import GLOBAL_SEED, seed64, unit


def matching(rows: DataFrame, criteria: list[dict]) -> DataFrame:
    """Rows that meet a criterion, a dictionary of equalities; a row that meets two comes twice."""
    parts = [rows.where(reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in one.items()), F.lit(True))) for one in criteria]
    return reduce(DataFrame.unionAll, parts) if parts else rows


def clean(rows: DataFrame, text: str = "text", least: int = 1, most: int | None = None) -> DataFrame:
    """Rows with a text that is not blank and not the word null, of a length within bounds."""
    t = F.col(text)
    keep = t.isNotNull() & (F.trim(t) != "") & (F.lower(F.trim(t)) != "null") & (F.length(t) >= least)
    return rows.where(keep & (F.length(t) <= most) if most else keep)


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def preferred_first(rows: DataFrame, key: list[str], source: str, preferred: str, order: list) -> DataFrame:
    """The first row of each key, those of the preferred source before all others."""
    return first_of(rows, key, [F.col(source) != preferred, *order])


def duplicates(rows: DataFrame, key: str, member: str) -> DataFrame:
    """(key, n, members): keys with more than one row, members in order."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(member)).alias("members")).where("n > 1")


def split(rows: DataFrame, key: str, ratio: float, seed: int = GLOBAL_SEED) -> DataFrame:
    """rows with split: a share of about ``ratio`` is validation, the rest train."""
    return rows.withColumn("split", F.when(unit(F.lit(seed), F.col(key)) < ratio, "validation").otherwise("train"))


def split_exact(rows: DataFrame, key: str, test: float, seed: int = GLOBAL_SEED) -> DataFrame:
    """rows with split by rank of their seeds: ceil(test * n) rows are held out, the first half of them for validation."""
    seeded = rows.withColumn("__seed", seed64(F.lit(seed), F.col(key)))
    n = rows.count()
    held = -(-int(round(test * n * 1_000_000)) // 1_000_000)
    out = numbered(seeded, "__seed", "__place")
    return out.withColumn("split", F.when(F.col("__place") > held, "train").when(F.col("__place") > held // 2, "test").otherwise("validation")).drop("__place", "__seed")


def sample(rows: DataFrame, n: int, key: str, seed: int = GLOBAL_SEED, by: list[str] | None = None) -> DataFrame:
    """n rows drawn by seed, or n of each group."""
    drawn = seed64(F.lit(seed), F.col(key))
    if not by:
        return rows.orderBy(drawn, key).limit(n)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(drawn, F.col(key)))
    return rows.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth")


def weighted_choice(key: Column, options: list, weights: list[float], seed: int = GLOBAL_SEED) -> Column:
    """One of the options by weight."""
    u, total, out = unit(F.lit(seed), key), 0.0, None
    for option, weight in zip(options, weights):
        total += weight
        out = F.when(u < total, F.lit(option)) if out is None else out.when(u < total, F.lit(option))
    return out.otherwise(F.lit(options[-1]))


def interleave(rows: DataFrame, source: str, order: list) -> DataFrame:
    """rows with position: the sources' first rows, then their second ones, until all are through."""
    nth = F.row_number().over(Window.partitionBy(source).orderBy(*order)).cast("long")
    return rows.withColumn("turn", nth)


def running(rows: DataFrame, amount: str, order: str, name: str = "running", parts: int = 64) -> DataFrame:
    """rows with the sum of an amount up to and with each row, in order of a unique column.

    No window runs over all rows: they are dealt into ranges of the order column, summed within each
    range, and ranges' totals (one row each) are summed before.
    """
    bounds = sorted(set(rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 1000)).first()[0] or []))
    part = reduce(lambda a, b: a + b, (F.when(F.col(order) > b, 1).otherwise(0) for b in bounds), F.lit(0))
    dealt = rows.withColumn("__part", part)
    totals = dealt.groupBy("__part").agg(F.sum(amount).alias("__total"))
    before = F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("__part", before.alias("__before"))
    inside = F.sum(amount).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("__inside", inside).join(F.broadcast(totals), "__part").withColumn(name, F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows numbered from 1 in order of a unique number; no window runs over all rows."""
    return running(rows.withColumn("__one", F.lit(1)), "__one", order, name).drop("__one")


def within_budget(rows: DataFrame, amount: str, budget: int, order: str) -> DataFrame:
    """The longest beginning of the rows whose amounts add up to no more than the budget."""
    return running(rows, amount, order, "__running").where(F.col("__running") <= budget).drop("__running")


def shards(rows: DataFrame, size: int, order: list, by: list[str] | None = None) -> DataFrame:
    """rows with shard: row i, from 0 in order, goes to shard i // size; of each group, or of all.

    In order of one number, of all rows, numbering is two-level; another order of all is one task's work.
    """
    if not by and len(order) == 1 and dict(rows.dtypes).get(order[0]) in ("int", "bigint"):
        return numbered(rows, order[0], "shard").withColumn("shard", F.floor((F.col("shard") - 1) / size).cast("long"))
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return rows.withColumn("shard", F.floor((F.row_number().over(window) - 1) / size).cast("long"))


def manifest(sharded: DataFrame, kind: str) -> DataFrame:
    """(type, index, rows) of each shard."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows")).select(F.lit(kind).alias("type"), F.col("shard").alias("index"), "rows")


def cadence(shard: Column, kind: str, start: int = 1, growth: int = 2) -> Column:
    """The step at which a shard, from 0, is taken: steps of equal, growing, or doubling numbers of shards."""
    if kind == "static":
        return F.floor(shard / start).cast("long")
    if kind == "linear":  # start, start + growth, start + 2 * growth ...: the root of a quadratic
        a, b = growth / 2.0, start - growth / 2.0
        return F.floor((-b + F.sqrt(b * b + 4 * a * shard)) / (2 * a) + 1e-9).cast("long")
    return F.floor(F.log2(shard / start + 1) + 1e-9).cast("long")


def matched_controls(rows: DataFrame, group: str, loss: str, control: str, by: list[str], key: str, seed: int = GLOBAL_SEED) -> DataFrame:
    """The losses, and as many controls of each dataset, drawn by seed; a blind order by seed."""
    lost = rows.where(F.col(group) == loss)
    wanted = lost.groupBy(*by).agg(F.count("*").alias("__n"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(seed64(F.lit(seed), F.col(key)), F.col(key)))
    drawn = rows.where(F.col(group) == control).withColumn("__nth", nth).join(wanted, by).where("__nth <= __n").drop("__nth", "__n")
    return lost.unionByName(drawn).withColumn("blind", seed64(F.lit("blind"), F.col(key)))


def upsert(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """old with the columns' new values where there are any."""
    fresh = new.select(*key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = old.join(fresh, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns))
