"""MinHash near-dedup with bottom-k sketches of one hash function.

A text is its set of word shingles. One pass makes each set's digest, size and sketch (its ``k``
smallest shingle hashes). Equal sets are one class from then on, whatever its size. Inverted lists
are keyed by runs of three neighbouring retained values: where two sets have a resemblance of 0.8,
at most a fifth of their union's values break runs, so for sets that the sketch holds whole some run
of three is always common (a run of two for sets of up to five), and for longer ones all but
certainly (a miss has odds under 1e-9 at 64 retained values). Lists of up to ``all_pairs`` members
give all their pairs; longer ones give each member's pair with the list's least member, and then, among
members that are not yet linked, pairs with its most central members and between neighbours by size,
until a round links nothing new. Those rounds only join most of a family cheaply. What is left between
different components is then searched whole: all members of long lists that share a shingle in their
prefixes (full sets, rarest shingles first: two sets as alike as asked must share one there) and whose
sizes and places of that shingle allow it. Union sketches estimate each pair, and exact Jaccard over the full sets verifies it.

Edge cases: a null or empty text, or one of white space only, has an empty set and no links. Rows
that repeat a doc_id are each judged by their own text. A null doc_id is never linked; its component is null and the row
is kept. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import annotate, arrow, blocks, cut, lists, release
from .components import components

#: Members of a prefix list that one part of it holds; other components' members go to every part.
PART = 256
#: Members of a list that one window over sizes holds.
RUN = 1000

FIELDS = [
    ("n_shingles", T.LongType(), pa.int64()),
    ("digest", T.BinaryType(), pa.binary()),
    ("sketch", T.ArrayType(T.LongType()), pa.list_(pa.int64())),
]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, ascending; fewer words than ``size`` are one shingle."""
    data = W.LOWER[data]
    start, end, first = W.words(data, offsets)
    h = W.Ranges(data)(start, end)
    n = max(0, len(h) - size + 1)
    grams = W.combine(*(h[i : i + n] for i in range(size))) >> np.uint64(1) if n else h[:0]
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            s = np.sort(grams[a : b - size + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield W.combine(np.array([b - a], np.uint64), *(h[i : i + 1] for i in range(a, b))) >> np.uint64(1)
        else:
            yield h[:0]


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """docs with n_shingles, digest (of the whole set; null if empty) and sketch, from column text."""

    def make():
        def work(batch):
            counts, digests, kept = [], [], []
            for _, _, data, offsets in blocks(batch, "text"):
                for s in shingle_sets(data, offsets, size):
                    counts.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    kept.append(s[:k].astype(np.int64))
            return [counts, digests, lists(np.concatenate(kept) if kept else np.empty(0, np.int64), [len(x) for x in kept], pa.int64())]

        return work

    return annotate(docs, FIELDS, make)


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are as alike as asked."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        for batch in batches:
            ok = []
            at = [batch.schema.get_field_index(c) for c in ("text_a", "text_b")]
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                sets = []
                for i in at:
                    one = pa.RecordBatch.from_arrays([part.column(i)], names=["text"])
                    sets.append([s for _, _, data, offsets in blocks(one, "text") for s in shingle_sets(data, offsets, size)])
                for x, y in zip(*sets):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"), run, "a long, b long")


def _fits(x: str, y: str, percent: int) -> Column:
    """Whether sets of two sizes can be as alike as asked."""
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _lists(reps: DataFrame, all_pairs: int) -> DataFrame:
    """Members of inverted lists with two or more: key, doc, n, and in long lists the least member as leader."""

    def runs_of(r: int) -> Column:
        # guarded: sequence(1, negative) would count down
        at = F.when(F.size("sketch") >= r, F.sequence(F.lit(1), F.size("sketch") - (r - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.lit(r), *(F.element_at("sketch", i + j) for j in range(r))))

    # Sets of up to five may share runs of two only; all others share runs of three.
    keys = F.when(F.col("n") <= 5, F.concat(runs_of(2), runs_of(3))).otherwise(runs_of(3))
    posted = reps.select("doc", "n", F.explode(keys).alias("key"))
    counted = posted.groupBy("key").agg(F.count("*").alias("members"), F.min("doc").alias("leader")).where("members > 1")
    leader = F.when(F.col("members") > all_pairs, F.col("leader")).alias("leader")
    return posted.join(counted.select("key", leader), "key").select("key", "doc", "n", "leader")


def _first_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of short lists, and of long ones each member with the least."""
    short = shared.where("leader is null").select("key", "doc", "n")
    pairs = (
        short.select("key", F.col("doc").alias("a"), F.col("n").alias("na"))
        .join(short.select("key", F.col("doc").alias("b"), F.col("n").alias("nb")), "key")
        .where((F.col("a") < F.col("b")) & _fits("na", "nb", percent))
        .select("a", "b")
    )
    star = shared.where("doc > leader").select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    return pairs.unionByName(star).distinct()


def _long_lists(shared: DataFrame) -> DataFrame:
    """Members of long lists, each with the number of all its long lists (central)."""
    own = Window.partitionBy("doc")
    return shared.where("leader is not null").select("key", "doc", "n", F.count("*").over(own).alias("central"))


def _prefixes(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(shingle, doc, n, place): the shingles that two or more texts have, at their places in each set's prefix.

    Places count from 1 in order of (number of texts, shingle) over the full set. Sets of n that are as
    alike as asked share one of their first n - ceil(percent * n / 100) + 1.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for row, _, data, offsets in blocks(batch, "text"):
                for i, s in enumerate(shingle_sets(data, offsets, size)):
                    made = [np.full(len(s), ids[row + i].as_py(), np.int64), np.full(len(s), len(s), np.int64), s.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["doc", "n", "shingle"])

    held = arrow(texts.select("doc_id", "text"), run, "doc long, n long, shingle long")
    counted = held.groupBy("shingle").agg(F.count("*").alias("members")).where("members > 1")
    own = Window.partitionBy("doc")
    # A shingle of one text stands before all others and pairs nothing: only its place counts.
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("members", "shingle"))
    rows = held.join(counted, "shingle").select("shingle", "doc", "n", place.alias("place"))
    return rows.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1)


def _rest(prefixes: DataFrame, found: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of different components that its prefixes allow, of which none was tested before."""
    rows = prefixes.count()
    placed = cut(prefixes.join(found, "doc", "left").select("shingle", "doc", "n", "place", F.coalesce("component", "doc").alias("component")), rows)
    sizes = placed.groupBy("shingle", "component").agg(F.count("*").alias("members"))
    lists = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.sum("members").alias("members"), F.count("*").alias("parts"))
    mixed = cut(placed.join(lists.where("parts > 1").select("shingle", "main", F.ceil(F.col("members") / PART).alias("parts")), "shingle"), rows)
    # A pair within the main component needs no test, so one of each pair is outside of it.
    outside = mixed.where("component <> main").select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"{c}_a") for c in ("doc", "n", "place", "component")))
    every = mixed.select("shingle", F.pmod(F.xxhash64("doc"), "parts").alias("part"), "doc", "n", "place", "component", (F.col("component") == F.col("main")).alias("within"))
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n") - F.col("place")) + 1
    allowed = rest * (100 + percent) >= (F.col("n_a") + F.col("n")) * percent
    once = F.col("within") | (F.col("doc_a") < F.col("doc"))
    pairs = outside.join(every, ["shingle", "part"]).where((F.col("component_a") != F.col("component")) & once & _fits("n_a", "n", percent) & allowed)
    return cut(pairs.select(F.least("doc_a", "doc").alias("a"), F.greatest("doc_a", "doc").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), rows)


def _rated(candidates: DataFrame, reps: DataFrame, percent: int, k: int, margin: float) -> DataFrame:
    """(a, b, whole) of candidates that pass by their sketches; whole: the sketches are the full sets, so that is exact."""
    side = lambda c: reps.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = candidates.join(side("a"), "a").join(side("b"), "b").where(_fits("na", "nb", percent))
    whole = F.greatest("na", "nb") <= k
    union = F.array_union("sa", "sb")
    union = F.when(whole, union).otherwise(F.slice(F.sort_array(union), 1, k))
    rated = both.withColumn("u", union).select("a", "b", whole.alias("whole"), F.size("u").alias("union"), F.size(F.array_intersect("u", F.array_intersect("sa", "sb"))).alias("same"))
    sure, likely = F.col("same") * 100 >= F.col("union") * percent, F.col("same") >= F.col("union") * (percent / 100 - margin)
    return cut(rated.where(F.when(F.col("whole"), sure).otherwise(likely)).select("a", "b", "whole"), candidates.count(), 10_000)


def _verified(rated: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    sure = rated.where("whole").select("a", "b")
    return cut(sure.unionByName(_verify(rated.where("not whole").select("a", "b"), texts, size, percent)).distinct(), rated.count(), 5_000)


def _found(links: DataFrame) -> DataFrame:
    """(doc, component) of all linked documents."""
    found = components(links, "a", "b").select(F.col("node").alias("doc"), "component")
    return cut(found, 2 * links.count())


def _reopened(members: DataFrame, heads: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and heads(key, first, next) of the lists that have pairs to compare which no round has: those whose next joined the first one's component.

    A list's first one, and neighbours by size, are the same in every round, and its next one is as long as it
    stays outside, since components only grow. So the other lists' pairs have all been tested.
    """
    side = lambda c: found.select(F.col("doc").alias(c), F.col("component").alias(f"{c}_component"))
    met = heads.join(side("first"), "first", "left").join(side("next"), "next", "left")
    same = cut(met.where(F.coalesce("first_component", "first") == F.coalesce("next_component", "next")).select("key"), heads.count())
    return members.join(same, "key", "left_semi"), heads.join(same, "key", "left_anti")


def _later_pairs(long: DataFrame, found: DataFrame, tested: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b) in different components that a later round compares, of which none was tested before.

    Besides them the members of the lists that are in more than one component, and (key, first, next) of those lists.
    """
    rows = long.count()
    placed = cut(long.join(found, "doc", "left").select("key", "doc", "n", "central", F.coalesce("component", "doc").alias("component")), rows)
    member, order = F.struct("doc", "n", "component"), F.struct("central", "doc")
    led = placed.groupBy("key").agg(F.max_by(member, order).alias("first"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("key", "first", F.ceil(F.col("members") / RUN).alias("parts"))
    mixed = cut(placed.join(led, "key"), rows)
    second = mixed.where(F.col("component") != F.col("first.component")).groupBy("key").agg(F.max_by(member, order).alias("next"))
    # Neighbours by size within parts of a list, so that a list of any length is no single window.
    before = F.lag(member).over(Window.partitionBy("key", F.pmod(F.xxhash64("doc"), "parts")).orderBy("n", "doc"))
    more = None
    # Only members outside the first one's component meet the second: the others would all be compared with one document.
    outside = mixed.where(F.col("component") != F.col("first.component"))
    for rated in (outside.withColumn("other", F.col("first")), outside.join(second, "key").withColumn("other", F.col("next")), mixed.withColumn("other", before)):
        pair = rated.where((F.col("component") != F.col("other.component")) & _fits("n", "other.n", percent)).select(F.least("doc", "other.doc").alias("a"), F.greatest("doc", "other.doc").alias("b"))
        more = pair if more is None else more.unionByName(pair)
    heads = led.select("key", F.col("first.doc").alias("first")).join(second.select("key", F.col("next.doc").alias("next")), "key")
    return cut(more.distinct().join(tested, ["a", "b"], "left_anti"), rows), mixed.select("key", "doc", "n", "central"), cut(heads, rows)


def _search(docs: DataFrame, size: int, percent: int, k: int, all_pairs: int, margin: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, links, found) of docs(doc_id, text); found: (doc, component) of linked class representatives."""
    spark = docs.sparkSession
    sets = cut(sketches(docs.select("doc_id", "text"), size, k).drop("text"))
    known = sets.where("digest is not null and doc_id is not null")
    total = known.count()
    heads = known.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = cut(sets.join(heads, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), total)
    # One row for each class; a digest's sketch and size are the same in all its rows.
    reps = cut(known.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")).drop("digest"), total, 8_000)
    del sets, known, heads
    shared = cut(_lists(reps, all_pairs), total, 8_000)
    release(spark)
    rows = shared.count()
    tested, long = cut(_first_pairs(shared, percent), rows), cut(_long_lists(shared), rows)
    del shared
    release(spark)
    rated = _rated(tested, reps, percent, k, margin)
    # The texts that any round may verify, found in one pass over all texts: those of likely pairs,
    # and those that stand in long lists.
    likely = rated.where("not whole")
    wanted = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).unionByName(long.select(F.col("doc").alias("doc_id"))).distinct()
    texts = cut(docs.select("doc_id", "text").where("doc_id is not null").join(wanted, "doc_id", "left_semi"), total, 8_000)
    del likely, wanted
    release(spark)
    links = _verified(rated, texts, size, percent)
    found = _found(links)
    if long.isEmpty():
        return classes, links, found
    members, closed = long, None
    while True:
        fresh, left, heads = _later_pairs(members, found, tested, percent)
        if closed is None:
            mixed = left
        else:
            heads = heads.unionByName(closed)
        new = _verified(_rated(fresh, reps, percent, k, margin), texts, size, percent)
        release(spark)
        tested = tested.unionByName(fresh)
        if new.isEmpty():
            break
        links = links.unionByName(new)
        found = _found(links)
        members, closed = _reopened(mixed, heads, found)
    held = texts.join(long.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    prefixes = cut(_prefixes(held, size, percent), total, 8_000)
    release(spark)
    rest = _rest(prefixes, found, tested, percent)
    new = _verified(_rated(rest, reps, percent, k, margin), texts, size, percent)
    release(spark)
    if not new.isEmpty():
        links = links.unionByName(new)
        found = _found(links)
    return classes, links, found


def near_links(docs: DataFrame, size: int = 5, percent: int = 80, k: int = 64, all_pairs: int = 24, margin: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of docs(doc_id, text).

    classes: doc_id, n_shingles, rep (smallest doc_id with an equal set; null for empty sets).
    links: (a, b) between class representatives, all verified over the full sets.
    """
    return _search(docs, size, percent, k, all_pairs, margin)[:2]


def near_dup(docs: DataFrame, size: int = 5, percent: int = 80, k: int = 64, all_pairs: int = 24, margin: float = 0.3) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reached by links, itself included), kept."""
    classes, _, found = _search(docs, size, percent, k, all_pairs, margin)
    component = F.coalesce("component", "rep", "doc_id")
    return classes.join(found, classes["rep"] == found["doc"], "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"),
    )
