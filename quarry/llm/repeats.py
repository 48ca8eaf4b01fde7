"""Suffix-array dedup: a depth-limited radix sort that finds exactly the repeated byte windows.

A window is ``width`` bytes within one document; it repeats if an equal window starts earlier
(smaller doc_id, or the same document and an earlier start). Sorting every suffix through ``width``
bytes would move many times the input, so the most-significant-digit passes run over anchored
suffixes: in every window the smallest of its ``width - 63``-byte grams (leftmost on ties) is its
anchor, equal windows have equal anchors at equal places, and one anchor stands for all windows in a
row that share it (about 32).

1. First digit: suffixes part by the anchor's gram. A gram met once ends the sort for its windows.
2. Second digit: the bytes of all windows of an anchor. Equal spans repeat whole, but for the first.
3. Third digit: where a gram has several different spans, each parts into quarters, its windows with
   the anchor 0 to 15, 16 to 31, 32 to 47 and 48 to 63 bytes in. What all windows of a quarter have
   in common (85 bytes) parts them first, then their whole bytes, as in pass 2.
4. Last digit: what is still mixed parts window by window.

Pass 1 and 2 are one shuffle of some 30 bytes for each anchor; each task first folds spans that it
meets twice itself, so groups of copies shrink before the shuffle. Groups of equal digits are never
collected: they are ranked by sorted windows that spill. Digits of spans are 64-bit hashes beside
that of their gram or common part, so two of them tell spans apart, also where a task folds its own;
pass 4 uses two as well.

Edge cases: a null or empty text has no bytes and gives zeros and the digest of no bytes. Texts
shorter than ``width`` lose nothing. Rows that repeat a doc_id are the same document, so neither is
earlier than the other. A row without doc_id loses nothing and counts for nothing. Overlapping
repeats within a document (a run of one character) lose all but the first window's bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import annotate, arrow, blocks, cut, release

#: Grams compared for a window's anchor: a power of two, for a sliding minimum by doubling.
SPAN = 64
U = np.uint64
#: Bits of a place within a stretch, and windows of a stretch.
PLACE_BITS, STRETCH = 24, 1 << 23
#: Anchors that a task folds at once.
FOLD = 400_000
#: Windows of a quarter of an anchor's span.
QUARTER = SPAN // 4
ANCHORS = "gram long, seg long, doc_id long, lo int, hi int, at int"


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, ranges: W.Ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of every maximal row of windows that share an anchor.

    Which gram is a window's smallest depends on nothing but the window: hashes are compared through
    the same upper bits in blocks of any size, and longer texts are looked at in overlapping stretches.
    """
    if len(offsets) < 2 or len(data) < width or np.diff(offsets).max() < width:
        none = np.empty(0, np.int64)
        return none, none, none
    ends = np.repeat(offsets[1:], np.diff(offsets))
    found = [_anchors(c, min(c + STRETCH + width - 1, len(data)), ends, width, ranges) for c in range(0, len(data) - width + 1, STRETCH)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(low: int, high: int, ends: np.ndarray, width: int, ranges: W.Ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the windows within bytes low to high."""
    gram, n = width - SPAN + 1, high - low
    at = np.arange(n - gram + 1)
    place = U((1 << PLACE_BITS) - 1)
    least = (ranges(at + low, at + low + gram) & ~place) | at.astype(np.uint64)
    step = 1
    while step < SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    windows = np.arange(low, low + len(least))
    whole = windows + width <= ends[low : low + len(least)]
    windows, anchor = windows[whole], (least[whole] & place).astype(np.int64) + low
    if not len(windows):
        return windows, windows, windows
    change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first, last = np.concatenate([[0], change]), np.concatenate([change - 1, [len(windows) - 1]])
    return windows[first], windows[last], anchor[first]


def _folded(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Anchors' rows; of equal spans among them only the first goes on, later ones repeat whole."""
    gram, seg, doc, lo, hi, at = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((lo, doc, gram, seg))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (gram[order][1:] != gram[order][:-1]) | (seg[order][1:] != seg[order][:-1])
    head = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
    same = (doc[order] == doc[head]) & (lo[order] == lo[head])  # repeated rows of one document
    done = order[~fresh & ~same]
    goes = order[fresh]
    done_doc, done_lo, done_hi = joined(doc[done], lo[done], hi[done] + 1)
    count = len(done_doc)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([gram[goes], W.mix(done_doc.astype(np.uint64) * U(3) + done_lo.astype(np.uint64))]).view(np.int64)),
            pa.array(np.concatenate([seg[goes].view(np.int64), np.zeros(count, np.int64)])),
            pa.array(np.concatenate([doc[goes], done_doc])),
            pa.array(np.concatenate([lo[goes], done_lo]).astype(np.int32)),
            pa.array(np.concatenate([hi[goes], done_hi - 1]).astype(np.int32)),
            pa.array(np.concatenate([at[goes], np.full(count, -1)]).astype(np.int32)),  # -1: repeats whole
        ],
        names=["gram", "seg", "doc_id", "lo", "hi", "at"],
    )


def _anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, end, data, offsets in blocks(batch, "text"):
                ranges = W.Ranges(data)
                lo, hi, at = anchors(data, offsets, width, ranges)
                doc = np.searchsorted(offsets, lo, side="right") - 1
                gram = ranges(at, at + width - SPAN + 1)
                seg = W.combine(ranges(lo, hi + width), (at - lo).astype(np.uint64))
                parts.append((gram, seg, ids[row:end][doc], lo - offsets[doc], hi - offsets[doc], at - offsets[doc]))
                held += len(lo)
                if held >= FOLD:
                    yield _folded(parts)
                    parts, held = [], 0
        if parts:
            yield _folded(parts)

    return arrow(docs, run, ANCHORS)


def joined(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges [lo, hi) of each document, with those that touch or overlap made one."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    # The furthest end so far within a document, by a running maximum over ends lifted above earlier documents.
    part = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    lift = part * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + lift)
    new = np.ones(len(doc), bool)
    new[1:] = (lo[1:] + lift[1:] > reach[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    return doc[first], lo[first], (reach - lift)[last]


def _open_spans(docs: DataFrame, spans: DataFrame, rows_of, schema: str) -> DataFrame:
    """rows_of(ranges, other ranges, ids, offsets, doc, lo, hi, at) over the open spans of each document."""
    gathered = spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "at")).alias("spans"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(batch.schema.get_field_index("__spans")).is_valid())
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)
            column = batch.column(batch.schema.get_field_index("__spans"))
            for row, end, data, offsets in blocks(batch, "text"):
                part = column.slice(row, end - row)
                doc = np.repeat(np.arange(end - row), np.diff(part.offsets.to_numpy()))
                lo, hi, at = (part.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) + offsets[doc] for i in range(3))
                for made in rows_of(W.Ranges(data), W.Ranges(data, salt=1), offsets, doc, lo, hi, at):
                    doc_of, one, two, *places = made
                    places = [pa.array((x - offsets[doc_of]).astype(np.int32)) for x in places]
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(ids[row:end][doc_of]), *places], names=names)

    # A left join of the very rows that the removal joins, so that texts are shuffled once for both.
    both = docs.join(gathered.select(F.col("doc_id").alias("__doc"), F.col("spans").alias("__spans")), F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    return arrow(both, run, schema)


def _quarter_rows(width: int):
    def rows_of(one, two, offsets, doc, lo, hi, at):
        for q in range(0, SPAN, QUARTER):
            first, last = np.maximum(lo, at - q - QUARTER + 1), np.minimum(hi, at - q)
            keep = (first <= last) & (last + width <= offsets[doc + 1])
            first, last, a = first[keep], last[keep], at[keep]
            core = W.combine(one(a - q, a - q - QUARTER + 1 + width), np.full(len(a), q, np.uint64))
            yield doc[keep], core, W.combine(two(first, last + width), (a - first).astype(np.uint64)), first, last, a

    return rows_of


def _window_rows(width: int):
    def rows_of(one, two, offsets, doc, lo, hi, at):
        counts = hi - lo + 1
        for i in range(0, len(lo), 20_000):
            n, d = counts[i : i + 20_000], doc[i : i + 20_000]
            ends = np.cumsum(n)
            a = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(lo[i : i + 20_000], n)
            d = np.repeat(d, n)
            keep = a + width <= offsets[d + 1]
            a, d = a[keep], d[keep]
            yield d, one(a, a + width), two(a, a + width), a

    return rows_of


def _ranked(rows: DataFrame, first: str, second: str) -> DataFrame:
    """What repeats whole (at is -1) and what is still mixed of spans with two digits."""
    same = Window.partitionBy(first, second).orderBy("doc_id", "lo")
    group = Window.partitionBy(first)
    later = (F.col("at") < 0) | (F.col("nth") > 1)
    return (
        rows.repartition(first)
        .select("*", F.rank().over(same).alias("nth"), F.min(second).over(group).alias("least"), F.max(second).over(group).alias("most"))
        .where("at < 0 or nth > 1 or least <> most")
        .select("doc_id", "lo", "hi", F.when(later, F.lit(-1)).otherwise(F.col("at")).alias("at"))
    )


def repeated_ranges(docs: DataFrame, width: int = 100) -> DataFrame:
    """(doc_id, spans): for each document with any, window starts [lo, hi] that repeat earlier windows."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = cut(_ranked(_anchor_rows(texts, width), "gram", "seg"))
    release(docs.sparkSession)
    quarters = _open_spans(docs, marks.where("at >= 0"), _quarter_rows(width), "core long, seg long, doc_id long, lo int, hi int, at int")
    parts = cut(_ranked(quarters, "core", "seg"))
    del quarters
    release(docs.sparkSession)
    windows = _open_spans(docs, parts.where("at >= 0"), _window_rows(width), "one long, two long, doc_id long, lo int")
    last = Window.partitionBy("one", "two").orderBy("doc_id", "lo")
    later = windows.select("doc_id", "lo", F.rank().over(last).alias("nth")).where("nth > 1").select("doc_id", "lo", F.col("lo").alias("hi"))
    whole = marks.unionByName(parts).where("at < 0").select("doc_id", "lo", "hi")
    return whole.unionByName(later).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


REMOVED = [
    ("n_bytes", T.LongType(), pa.int64()),
    ("removed_spans", T.ArrayType(T.ArrayType(T.LongType())), pa.list_(pa.list_(pa.int64()))),
    ("kept_bytes", T.BinaryType(), pa.binary()),
]


def remove_repeats(docs: DataFrame, width: int = 100, names: dict[str, str] | None = None) -> DataFrame:
    """Every row of docs with n_bytes, removed_spans ([start, end) byte ranges, maximal) and kept_bytes."""
    spans = repeated_ranges(docs, width).withColumnRenamed("spans", "__spans").withColumnRenamed("doc_id", "__doc")
    both = docs.join(spans, docs["doc_id"] == spans["__doc"], "left").drop("__doc")

    def make():
        def work(batch):
            sizes, removed, kept = [], [], []
            column = batch.column(batch.schema.get_field_index("__spans"))
            for row, end, data, offsets in blocks(batch, "text"):
                for i in range(end - row):
                    text = data[offsets[i] : offsets[i + 1]]
                    sizes.append(len(text))
                    cell = column[row + i]
                    if not cell.is_valid:
                        removed.append([])
                        kept.append(text.tobytes())
                        continue
                    lo, hi = (cell.values.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1))
                    ok = hi + width <= len(text)
                    lo, hi = lo[ok], hi[ok]
                    _, lo, hi = joined(np.zeros(len(lo), np.int64), lo, hi + width)
                    gone = np.zeros(len(text) + 1, np.int64)
                    np.add.at(gone, lo, 1)
                    np.add.at(gone, hi, -1)
                    removed.append(np.stack([lo, hi], axis=1).tolist())
                    kept.append(text[np.cumsum(gone[:-1]) == 0].tobytes())
            return [sizes, removed, kept]

        return work

    return annotate(both, REMOVED, make, names).drop("__spans")


def digest_rows(docs: DataFrame, width: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    out = remove_repeats(docs.select("doc_id", "text"), width)
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept_bytes")).alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
