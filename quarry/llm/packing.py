"""Best-fit packing of token pieces into sequences of a fixed capacity.

``encode`` cuts every text's token ids into pieces; ``pack`` gives each piece a sequence and a place
in it. Only the number of pieces of each length matters for that, and there are at most ``capacity``
lengths, so the plan is made on the driver from a histogram of that many rows, whatever the table's
size, in bulk steps over whole length classes:

* Dominance reduction after Martello and Toth: for a length ``j``, a set of pieces that dominates
  every other set that could share a sequence with ``j`` is fixed for good, as many times as both
  classes last. It is ``j`` alone if nothing fits beside it; ``j`` with the largest fitting length
  if they fill the sequence, or if no two others fit beside ``j``, or if no two or more others that
  fit reach that length's sum; or the triple of ``j``, the largest fitting length and the largest
  third, if no more than two fit and no pair has its smaller part above that third. This repeats
  until nothing more is dominated.
* What remains is packed by best fit, longest first, each piece into the fullest sequence it fits.

The plan is a list of intervals: pieces number a..b of a length go k by k to sequences from s on, at
offset o. Each step fixes one class or splits one range of sequences, so there are a few thousand
intervals at most (tests hold this bound). Pieces are numbered within their length by a count for
each (length, hash bucket) and a row number inside it, so no length class is one group, and every
piece finds its interval by a binary search.

Edge cases: a null or empty text is the end mark alone, one piece of length 1. Texts longer than the
capacity are cut so that only the first piece may be shorter. Repeated rows are packed as often as
they occur. A null doc_id is packed like any other. An empty table gives an empty result. A length
above the capacity or below 1, which ``encode`` never makes, is an error.
"""

from __future__ import annotations

import json
from bisect import bisect_right

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, blocks, cut

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
#: Hash buckets in which pieces of one length are numbered; a bucket holds 1/256 of a length class.
BUCKETS = 256


def load_tokenizer(path: str):
    """The byte-level BPE of a tokenizers JSON file, run by tiktoken: the same ids, several times as fast.

    Special tokens' strings in a text become their ids, as tokenizers does by default.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    # Byte-level vocabularies write each byte as a printable character: itself or one from 256 on.
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first."""
    first = (length - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def encode(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece of docs."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches):
        bpe = load_tokenizer(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            text = batch.column(batch.schema.get_field_index("text"))
            for row, stop, _, _ in blocks(batch, "text"):
                source, piece, start, length, tokens = [], [], [], [], []
                for i, t in enumerate(text.slice(row, stop - row).to_pylist()):
                    found = np.empty(0, np.uint32) if not t else bpe.encode_to_numpy(t, allowed_special="all").astype(np.uint32)
                    found = np.append(found, np.uint32(end)).astype("<u4")
                    for n, (at, size) in enumerate(cuts(len(found), capacity)):
                        source.append(row + i)
                        piece.append(n)
                        start.append(at)
                        length.append(size)
                        tokens.append(found[at : at + size].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


class Plan:
    """Where the pieces of each length go: intervals (length, from, to, first sequence, copies in one, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
            raise ValueError("a piece's length must be from 1 to the capacity")
        self.capacity, self.left = capacity, {s: n for s, n in histogram.items() if n}
        self.given = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.intervals: list[tuple[int, int, int, int, int, int]] = []
        self._reduce()
        self._best_fit()

    def _place(self, size: int, count: int, first: int, copies: int, offset: int) -> None:
        """Give ``count`` pieces of a length to sequences from ``first`` on, ``copies`` to each."""
        at = self.given[size]
        self.intervals.append((size, at, at + count, first, copies, offset))
        self.given[size] = at + count
        self.left[size] -= count
        if not self.left[size]:
            del self.left[size]

    def _fix(self, sizes: list[int]) -> None:
        """Fix a dominating set as often as its classes last."""
        copies = {s: sizes.count(s) for s in sizes}
        times = min(self.left[s] // n for s, n in copies.items())
        offset = 0
        for s, n in copies.items():
            self._place(s, times * n, self.sequences, n, offset)
            offset += s * n
        self.sequences += times

    def _dominating(self, j: int, sizes: list[int]) -> list[int] | None:
        """The set that dominates all others with a piece of length j, if one is proven; sizes: ascending."""
        room = self.capacity - j
        has = lambda s: self.left[s] - (s == j)  # noqa: E731  pieces of a length beside this one
        fits = [s for s in sizes[: bisect_right(sizes, room)] if has(s)]
        if not fits:
            return [j]
        best = fits[-1]
        if best == room:
            return [j, best]
        small = [s for s in fits[:3] for _ in range(min(3, has(s)))][:3]  # the three smallest pieces
        if len(small) < 2 or small[0] + small[1] > room:
            return [j, best]
        if len(small) == 3 and sum(small) <= room:
            return None  # three more may fit: nothing is proven here
        most, hi = 0, len(fits) - 1
        for lo, s in enumerate(fits):  # the largest sum of two that fits
            while hi >= lo and (s + fits[hi] > room or (hi == lo and has(s) < 2)):
                hi -= 1
            if hi < lo:
                break
            most = max(most, s + fits[hi])
        if most <= best:
            return [j, best]
        thirds = [s for s in fits if best + s <= room and has(s) >= 1 + (s == best)]
        if thirds:
            above = [s for s in fits if s > thirds[-1] for _ in range(min(2, has(s)))][:2]
            if len(above) < 2 or sum(above) > room:
                return [j, best, thirds[-1]]
        return None

    def _reduce(self) -> None:
        going = True
        while going:
            going = False
            for j in sorted(self.left, reverse=True):
                while j in self.left:
                    found = self._dominating(j, sorted(self.left))
                    if found is None or any(self.left[s] < found.count(s) for s in found):
                        break
                    self._fix(found)
                    going = True

    def _best_fit(self) -> None:
        """Best fit, longest first, over ranges of sequences with equal room: room to [(first, count)]."""
        ranges: dict[int, list[tuple[int, int]]] = {}
        for size in sorted(self.left, reverse=True):
            rooms = sorted(r for r in ranges if r >= size)
            while size in self.left:
                count = self.left[size]
                if rooms:
                    room = rooms[0]
                    first, have = ranges[room].pop()
                    if not ranges[room]:
                        del ranges[room]
                        rooms.pop(0)
                else:
                    room, first, have = self.capacity, self.sequences, -(-count // (self.capacity // size))
                    self.sequences += have
                each = room // size
                full = min(have, count // each)
                if full:
                    self._place(size, full * each, first, each, self.capacity - room)
                    ranges.setdefault(room - each * size, []).append((first, full))
                rest = count - full * each
                if full < have:
                    if 0 < rest < each:
                        self._place(size, rest, first + full, rest, self.capacity - room)
                        ranges.setdefault(room - rest * size, []).append((first + full, 1))
                        full += 1
                    if full < have:
                        ranges.setdefault(room, []).append((first + full, have - full))

    def table(self) -> np.ndarray:
        """Intervals ordered by (length, from)."""
        return np.array(sorted(self.intervals), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """pieces (any columns beside doc_id, piece and length) with sequence_id and offset.

    pieces must give the same rows whenever it is read: a table, or a checkpoint.
    """
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length
    plan = Plan(histogram, capacity).table()
    keyed = pieces.drop("sequence_id", "offset").withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("length").alias("__length"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")
    numbered = keyed.withColumn("__nth", F.row_number().over(within).cast("long"))
    numbered = numbered.join(counts, (F.col("length") == F.col("__length")) & (F.col("__bucket") == F.col("__b")))
    numbered = numbered.withColumn("__nth", F.col("__nth") + F.col("__before") - 1).drop("__bucket", "__length", "__b", "__before")
    kept = [f for f in numbered.schema.fields if f.name != "__nth"]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        # Within a length intervals follow one another, so (length, from) is ascending as one key.
        scale = int(plan[:, 2].max()) + 1 if len(plan) else 1
        keys = plan[:, 0] * scale + plan[:, 1]
        for batch in batches:
            length, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__nth"))
            row = plan[np.searchsorted(keys, length * scale + nth, side="right") - 1]
            place = nth - row[:, 1]
            copies = np.maximum(row[:, 4], 1)
            made = [pa.array(row[:, 3] + place // copies), pa.array(row[:, 5] + place % copies * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), *made], names=[*(f.name for f in kept), "sequence_id", "offset"])

    return arrow(numbered, run, schema)


def packed_digests(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs."""
    pieces = encode(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut(pieces))
