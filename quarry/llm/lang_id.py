"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. A trigram binds its letters' vectors, shifted by
two places, one and none, with an elementwise product; a text bundles (adds) its trigrams' vectors;
a language's prototype bundles all its training texts. The prediction is the language whose
prototype has the largest cosine with the text's vector, and the score is that cosine (0 if
negative).

Letters are a to z, 13 classes for all other letters by code point, and one symbol for any run of
other characters; so a text is a sequence over 40 symbols and its trigrams have 64,000 codes, which
are counted first and bundled by count. Training adds count vectors up on the executors: a task
emits one vector of ``DIMS`` numbers for each language it met, and these sums are all that reaches
the driver. The number of languages is that of distinct labels, assumed to be small.

Edge cases: a null text, or one without a letter, is `und` with score 0. Where nothing could be
learned (no labelled row) every text is `und`. Ties go to the language first in order. Rows whose
label is null teach nothing; repeated rows teach as often as they occur. Very long texts are counted
piece by piece, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, arrow

DIMS = 1024
LETTERS = 40
OTHER = "und"
FIELDS = [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64())]

_tables: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """Symbol of every code point: 1..26 for a..z, 27..39 for other letters, 0 for the rest."""
    if "letters" not in _tables:
        table = np.zeros(0x110000, np.uint8)
        table[0x80:] = np.fromiter((27 + (c * 2_654_435_761 >> 16) % 13 if chr(c).isalpha() else 0 for c in range(0x80, 0x110000)), np.uint8, 0x110000 - 0x80)
        for c in range(26):
            table[ord("a") + c] = table[ord("A") + c] = c + 1
        for c in range(0x80, 0x24F):  # Latin capitals as their small letters
            small = chr(c).lower()
            if len(small) == 1:
                table[c] = table[ord(small)]
        _tables["letters"] = table
    return _tables["letters"]


def vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors as they stand first, second and third in a trigram."""
    v = np.random.default_rng(7).integers(0, 2, size=(LETTERS, DIMS), dtype=np.int8) * 2 - 1
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """(codes, counts) of a text's trigrams, and whether it has a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = letter_table()[points]
    lettered = bool(s.any())
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)  # a run of other characters is one symbol
    s = np.concatenate([[0], s[keep], [0]]).astype(np.int32)
    codes = (s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:]
    if len(codes) < 4000:
        codes, counts = np.unique(codes, return_counts=True)
        return codes, counts, lettered
    counts = np.bincount(codes, minlength=LETTERS**3)
    codes = np.flatnonzero(counts)
    return codes, counts[codes], lettered


def bundle(codes: np.ndarray, counts: np.ndarray, v: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Sum of trigram vectors, each as often as counted."""
    out = np.zeros(DIMS, np.float32)
    for i in range(0, len(codes), 2048):
        c = codes[i : i + 2048]
        bound = v[0][c // LETTERS**2] * v[1][c // LETTERS % LETTERS] * v[2][c % LETTERS]
        out += counts[i : i + 2048].astype(np.float32) @ bound.astype(np.float32)
    return out


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes of the languages of docs(text, lang)."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for lang, text in zip(langs, batch.column(batch.schema.get_field_index("text")).to_pylist()):
                codes, counts, _ = trigram_counts(text)
                sums.setdefault(lang, np.zeros(LETTERS**3, np.int64))[codes] += counts
        v = vectors()
        rows = []
        for lang, total in sums.items():
            codes = np.flatnonzero(total)
            # In float64: a task's totals may pass what float32 holds exactly.
            vector = np.zeros(DIMS)
            for i in range(0, len(codes), 2048):
                c = codes[i : i + 2048]
                bound = v[0][c // LETTERS**2] * v[1][c // LETTERS % LETTERS] * v[2][c % LETTERS]
                vector += total[c].astype(np.float64) @ bound.astype(np.float64)
            rows += [(lang, d, int(x)) for d, x in enumerate(vector)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["lang", "at", "value"])

    known = docs.where("text is not null and lang is not null").select("text", "lang")
    sums = arrow(known, run, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for row in sums.collect():  # DIMS numbers for each language
        found.setdefault(row.lang, np.zeros(DIMS))[row.at] = row.value
    return {lang: x / n for lang, x in found.items() if (n := np.linalg.norm(x))}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], names: dict[str, str] | None = None) -> DataFrame:
    """Every row of docs with lang_pred and score."""
    langs = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in langs], np.float32)

    def make():
        v = vectors()

        def work(batch):
            labels, scores = [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                codes, counts, lettered = trigram_counts(text) if text else ((), (), False)
                if not lettered or not langs:
                    labels.append(OTHER)
                    scores.append(0.0)
                    continue
                x = bundle(codes, counts, v)
                cosines = matrix @ (x / max(float(np.linalg.norm(x)), 1e-9))
                best = int(np.argmax(cosines))
                labels.append(langs[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            return [labels, scores]

        return work

    return annotate(docs, FIELDS, make, names)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of docs(doc_id, text, lang); learned from the rows not held out."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    prototypes = learn(rows.where("not held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")
