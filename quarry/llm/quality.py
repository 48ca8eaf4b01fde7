"""Quality rules: statistics of whole texts, two fixed rules, and boosted trees for the verdict.

The trees are fitted on labelled documents (a row of ``labels`` with a quality of 0 or 1), at most
``SAMPLE`` of them, those with the smallest hash of their id; all counts are over whole texts. The
verdict may only fall as a text has relatively more symbols, repeated words, repeated lines or
capitals, by monotone constraints. Without labels of both kinds the fixed rules alone decide.

Edge cases: a null text has no words, like an empty one, and fails the base rules. Words are parted
by ASCII white space only; lines by line feeds. A line counts as repeated if it has a word and an
earlier line of the text is equal byte for byte. Repeated rows get equal results. A label whose
document is missing, or null, teaches nothing; a document labelled several times teaches with each
label. Texts of any length are counted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from . import words as W
from .common import annotate, blocks

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 20_000
#: Documents of which the trees find the odds of good quality below this are not kept.
KEEP = 0.35

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0") : ord("9") + 1] = True
#: Statistics for the rules and the trees, all counts.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")
#: What the trees see, and which way the verdict may go with it.
RATIOS = {"symbols": -1, "repeats": -1, "dup_lines": -1, "upper": -1, "digits": 0, "mean_word": 0, "distinct": 0, "line_words": 0, "marks": 0, "log_words": 0}


def _repeats(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted order, whether a key is found again in its row, whether it was found before), in that order."""
    mixed = W.mix(keys + W.mix(row.astype(np.uint64)))  # a key of its own for each row
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    before, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
    before[1:], again[:-1] = same, same
    return order, again, before


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of every row of a block, as columns."""
    rows = len(offsets) - 1
    start, end, first = W.words(data, offsets)
    ranges = W.Ranges(data)
    hashes = ranges(start, end)
    n_words = np.diff(first)
    word_row = np.repeat(np.arange(rows), n_words)
    upto = np.concatenate([[0], np.cumsum(W.HEAD[data])])
    chars = np.bincount(word_row, weights=upto[end] - upto[start], minlength=rows).astype(np.int64)
    # Words in three-word windows that the text has twice or more.
    n = max(0, len(hashes) - 2)
    grams = W.combine(hashes[:n], hashes[1 : n + 1], hashes[2:]) if n else hashes[:0]
    whole = word_row[:n] == word_row[2:] if n else np.empty(0, bool)
    at = np.flatnonzero(whole)
    order, again, before = _repeats(grams[at], word_row[at], rows)
    hit = np.zeros(len(hashes) + 2, bool)
    twice = at[order[again | before]]
    for i in range(3):
        hit[twice + i] = True
    repeat_words = np.bincount(word_row, weights=hit[: len(hashes)], minlength=rows).astype(np.int64)
    order, _, before = _repeats(hashes, word_row, rows)
    distinct = n_words - np.bincount(word_row[order[before]], minlength=rows)
    # Lines with a word: the line feeds part them, and a row's borders.
    a, b = W.runs(data != 10, offsets)
    worded = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b = a[worded], b[worded]
    line_row = np.searchsorted(offsets, a, side="right") - 1
    order, _, before = _repeats(ranges(a, b), line_row, rows)
    dup_lines = np.bincount(line_row[order[before]], minlength=rows)
    last = data[end - 1] if len(end) else data[:0]
    marks = np.bincount(word_row, weights=(last == ord(".")) | (last == ord(",")), minlength=rows).astype(np.int64)
    return np.stack([n_words, chars, W.totals(SYMBOL[data], offsets), dup_lines, repeat_words, np.bincount(line_row, minlength=rows), distinct, W.totals(UPPER[data], offsets), W.totals(DIGIT[data], offsets), marks], axis=1)


def ratios(c: np.ndarray) -> np.ndarray:
    """The trees' features out of COUNTS."""
    c = c.astype(np.float64)
    words, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), np.maximum(c[:, 5], 1)
    return np.stack([c[:, 2] / chars, c[:, 4] / words, c[:, 3] / lines, c[:, 7] / chars, c[:, 8] / chars, c[:, 1] / words, c[:, 6] / words, c[:, 0] / lines, c[:, 9] / words, np.log1p(c[:, 0])], axis=1)


def count_rows(docs: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Every row of docs with COUNTS, from column text."""

    def make():
        def work(batch):
            parts = [counts(data, offsets) for _, _, data, offsets in blocks(batch, "text")]
            whole = np.concatenate(parts) if parts else np.empty((0, len(COUNTS)), np.int64)
            return [np.ascontiguousarray(x) for x in whole.T]

        return work

    return annotate(docs, [(c, T.LongType(), pa.int64()) for c in COUNTS], make, names)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> boosting.Trees | None:
    """Trees for the labels' quality; None without labels of both kinds.

    ``sample`` bounds the labels, the first by a hash of their ids; of documents that repeat those ids
    at most four times as many rows are taken, the first in the same order, so any run fits the same rows.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("__doc"), F.col("quality").alias("__quality"))
    # The sample is bounded, so its ids may be sent to every task that reads texts.
    chosen = known.orderBy(F.xxhash64("__doc"), "__doc", "__quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc"))
    found = count_rows(rows.select("__doc", "__quality", "text")).select("__doc", "__quality", *COUNTS).orderBy(F.xxhash64("__doc"), "__doc", "__quality", *COUNTS).limit(4 * sample).collect()
    found.sort()
    y = np.array([r["__quality"] for r in found], np.float64)
    if not 0 < y.sum() < len(y):
        return None
    return boosting.fit(ratios(np.array([[r[c] for c in COUNTS] for r in found], np.int64)), y, list(RATIOS.values()))


def judge(docs: DataFrame, trees: boosting.Trees | None, least: float = KEEP) -> DataFrame:
    """Every row of docs with COUNTS, base_failed, quality (the odds found) and kept."""
    fields = [(c, T.LongType(), pa.int64()) for c in COUNTS] + [("base_failed", T.BooleanType(), pa.bool_()), ("quality", T.DoubleType(), pa.float64()), ("kept", T.BooleanType(), pa.bool_())]

    def make():
        def work(batch):
            parts = [counts(data, offsets) for _, _, data, offsets in blocks(batch, "text")]
            whole = np.concatenate(parts) if parts else np.empty((0, len(COUNTS)), np.int64)
            failed = (whole[:, 0] < 50) | (100 * whole[:, 4] > 50 * whole[:, 0])
            odds = trees.probability(ratios(whole)) if trees else np.ones(len(whole))
            return [*(np.ascontiguousarray(x) for x in whole.T), failed, odds, ~failed & (odds >= least)]

        return work

    return annotate(docs, fields, make)


def quality_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed and kept of each document."""
    return judge(docs.select("doc_id", "text"), learn(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("quality").alias("score"))
