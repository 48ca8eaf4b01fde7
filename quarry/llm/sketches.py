"""Document fingerprints: bottom-k sketches of shingle hashes, all in Spark's own functions.

A text's sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes of its word
shingles (five words; a text with fewer is one shingle). Sketches of parts merge into the sketch of
the union, and estimate resemblance, containment and the number of distinct shingles; while a set
has at most ``k`` shingles all of these are exact. A fingerprint is the sketch as hex text, 16 digits
for each value, in order.

Edge cases: a null or empty text, or one of white space only, has an empty sketch and the empty
fingerprint; two empty sketches are alike (1.0), an empty and a full one are not (0.0). Equal texts
have equal fingerprints. A null doc_id comes last in descending order, so it is followed by the
largest id; rows that repeat a doc_id follow one another in the order of their texts' hashes. Other
columns of the table are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes kept for a document, and words in a shingle.
KEPT, SHINGLE = 128, 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def sketch(text: Column, k: int = KEPT, size: int = SHINGLE) -> Column:
    """Bottom-k sketch of a text."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        last = F.greatest(F.size(h) - size, F.lit(0))
        grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(size))))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(grams)), 1, k))

    # The words' hashes are bound once, by a lambda's argument, not computed again for each use.
    return F.get(F.transform(F.array(hashed), of), F.lit(0))


def merge(a: Column, b: Column, k: int = KEPT) -> Column:
    """Sketch of the union of two sets, from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _shared(a: Column, b: Column, union: Column) -> Column:
    return F.size(F.array_intersect(union, F.array_intersect(a, b)))


def resemblance(a: Column, b: Column, k: int = KEPT) -> Column:
    """Estimated share of the union's shingles that both sets have."""
    union = merge(a, b, k)
    return F.when(F.size(union) == 0, 1.0).otherwise(_shared(a, b, union) / F.size(union))


def distinct_shingles(a: Column, k: int = KEPT) -> Column:
    """Estimated size of a set: exact below k, else (k - 1) over the k-th value's place in the hash range."""
    place = (F.element_at(a, F.lit(k)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = KEPT) -> Column:
    """Estimated share of a's shingles that b has."""
    size = distinct_shingles(a, k)
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / size))


def fingerprint(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def followed(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each row with the next in descending doc_id, the last with the first.

    Ids alone are dealt into ``parts`` ranges of about equal size by an approximate quantile pass;
    texts move once, to their range, where a window pairs neighbours. A range's first row also goes
    to the range before it as a border row (one for each range), so that no pair is lost between
    ranges.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = sorted({~int(b) for b in bounds})  # at most parts - 1 values
    # ~id falls as the id rises and cannot overflow; nulls come last.
    place = F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1))
    # Binary search for the range, as a nest of comparisons of logarithmic depth.
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(place < bounds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    made = rows.withColumn("part", search(0, len(bounds))).withColumn("place", place).withColumn("tie", F.xxhash64("text"))
    first = made.groupBy("part").agg(F.min(F.struct("place", "tie")).alias("first")).orderBy("part").collect()  # at most one row for each range
    if not first:
        return made.select("doc_id", "text", F.array().cast("array<bigint>").alias("sketch"), F.col("text").alias("next_text"), F.array().cast("array<bigint>").alias("next_sketch"))
    # Each range that has rows gets the first row of the next such range, the last one the very first row.
    source = {r.part: first[i - 1].part for i, r in enumerate(first)}
    border = {r.part: (r.first.place, r.first.tie) for r in first}
    by_part = lambda values: F.get(F.array(*(F.lit(values.get(p)).cast("bigint") for p in range(len(bounds) + 1))), F.col("part"))
    is_head = (F.col("place") == by_part({p: b[0] for p, b in border.items()})) & (F.col("tie") == by_part({p: b[1] for p, b in border.items()}))
    own = F.struct(F.col("part").cast("bigint").alias("part"), F.lit(False).alias("border"))
    goes = F.when(is_head, F.array(own, F.struct(by_part(source).alias("part"), F.lit(True).alias("border")))).otherwise(F.array(own))
    dealt = made.withColumn("sketch", sketch(F.col("text"))).withColumn("goes", F.explode(goes)).select("doc_id", "text", "sketch", "place", "tie", "goes.part", "goes.border")
    near = Window.partitionBy("part").orderBy("border", "place", "tie")
    return dealt.withColumn("next_text", F.lead("text").over(near)).withColumn("next_sketch", F.lead("sketch").over(near)).where("not border").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def edited_fingerprints(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    text, after = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(after, F.lit(1), half))
    rows = followed(docs, parts).select("doc_id", F.length(text).cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
