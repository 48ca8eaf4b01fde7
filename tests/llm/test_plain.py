"""What had no plain version: op3's verdicts, op5's predictions and op9's fingerprint strings, written out one by one."""

import math
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import lang_id, quality, sketches
from quarry.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "É é ß Ω я 日本 x1 y"), (6, "word " * 300), (7, "AbC. DeF, 12\n" * 60),
    (8, "a" * 300_000), (9, " ".join(f"w{i}" for i in range(40_000))), (10, "... 12 !"), (11, "\n".join(["# x | y"] * 80)), (12, "one two three four five"),
]


@pytest.fixture(scope="module")
def tables(spark):
    real = table(spark, SF, "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(i, t, "en") for i, t in ODD], "doc_id long, text string, lang string")
    return [(df, [tuple(r) for r in df.collect()]) for df in (real, odd)]


def plain_quality(t, trees):
    """Whether a text is kept: its statistics counted one by one, and every tree walked from its root."""
    t = t or ""
    words, seen, dup, lines = WORD.findall(t), set(), 0, 0
    for line in t.split("\n"):
        if WORD.search(line):
            lines, dup = lines + 1, dup + (line in seen)
            seen.add(line)
    grams = list(zip(words, words[1:], words[2:]))
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    if len(words) < 50 or 100 * len(hit) > 50 * len(words):
        return False, None
    n, chars = len(words), sum(map(len, words))
    shares = [
        sum(c in "#*$%&|<>" for c in t) / chars, len(hit) / n, dup / lines, sum("A" <= c <= "Z" for c in t) / chars, sum("0" <= c <= "9" for c in t) / chars,
        chars / n, len(set(words)) / n, n / lines, sum(w[-1] in ".," for w in words) / n, math.log1p(n),
    ]
    total = trees.base
    for k in range(len(trees.left)):
        at = 0
        while trees.left[k, at] != at:
            at = trees.left[k, at] if shares[trees.feature[k, at]] <= trees.bound[k, at] else trees.right[k, at]
        total += trees.value[k, at]
    odds = 1 / (1 + math.exp(-total))
    return odds >= quality.KEEP, odds


def test_op3_verdicts(spark, tables):
    labels = table(spark, SF, "labels")
    trees = quality.learn(tables[0][0], labels)
    verdicts = Counter()
    for df, rows in tables:
        got = {r.doc_id: r for r in quality.judge(df.select("doc_id", "text"), trees).collect()}
        for i, t, _ in rows:
            kept, odds = plain_quality(t, trees)
            if odds is not None:
                assert got[i].quality == pytest.approx(odds, abs=1e-9)
            if odds is None or abs(odds - quality.KEEP) > 1e-9:
                assert got[i].kept == kept
            verdicts[kept] += 1
    assert min(verdicts.values()) > 5


def plain_symbols(t):
    """The sequence over letters, classes of other letters and gaps, with a gap at both ends."""
    out = []
    for c in t:
        p = ord(c)
        if p < 128:
            s = ord(c.lower()) - 96 if c.isalpha() else 0
        else:
            low = c.lower() if p < 0x24F and len(c.lower()) == 1 else c
            p = ord(low)
            s = ord(low) - 96 if "a" <= low <= "z" else (27 + (p * 2_654_435_761 >> 16) % 13 if low.isalpha() else 0)
        if s or not out or out[-1]:
            out.append(s)
    return [0, *out, 0]


def plain_vector(t):
    """A text's bundle: every trigram's letters bound one by one."""
    first, second, third = (v.astype(np.int64) for v in lang_id.vectors())
    s = plain_symbols(t)
    grams = Counter(zip(s, s[1:], s[2:]))
    return sum((n * first[a] * second[b] * third[c] for (a, b, c), n in grams.items()), np.zeros(lang_id.DIMS, np.int64))


def test_op5_predictions(tables):
    import zlib

    for df, rows in tables:
        sums = defaultdict(lambda: np.zeros(lang_id.DIMS, np.int64))
        for i, t, lang in rows:
            if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
                sums[lang] += plain_vector(t)
        got = {r.doc_id: r for r in lang_id.identify(df).collect()}
        assert len(got) == len(rows)
        for i, t, _ in rows:
            if not any(plain_symbols(t or "")):
                assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
                continue
            x = plain_vector(t)
            cosines = {lang: float(x @ v) / math.sqrt(float(x @ x)) / math.sqrt(float(v @ v)) for lang, v in sums.items()}
            assert got[i].score == pytest.approx(max(0.0, max(cosines.values())), abs=1e-4)
            assert cosines[got[i].lang_pred] == pytest.approx(max(cosines.values()), abs=1e-4)


def plain_fingerprint(t, k=128, size=5):
    """The k smallest hashes of a text's shingles: each word hashed, then each window over its words' hashes."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in WORD.findall(t or "")]
    grams = set()
    for i in range(max(1, len(words) - size + 1) if words else 0):
        h = 42
        for w in words[i : i + size]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", w), seed=h)
        grams.add(signed(h))
    return "".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(grams)[:k])


def test_op9_fingerprint_strings(tables):
    for df, rows in tables:
        got = {r.doc_id: r for r in sketches.edited_fingerprints(df, 4).collect()}
        order = sorted(rows, key=lambda r: -r[0])
        for (i, t, _), (_, u, _) in zip(order, [*order[1:], order[0]]):
            t, u = t or "", u or ""
            edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
            assert got[i].fingerprint == plain_fingerprint(t)
            assert got[i].edited_fingerprint == plain_fingerprint(edited)
            for other, near in ((edited, got[i].near_edited), (u, got[i].near_next)):
                a, b = ([f[j : j + 16] for j in range(0, len(f), 16)] for f in (plain_fingerprint(t), plain_fingerprint(other)))
                union = sorted({*a, *b}, key=lambda h: int(h, 16) - (1 << 64 if h[0] in "89abcdef" else 0))[:128]
                assert near == (pytest.approx(sum(h in a and h in b for h in union) / len(union)) if union else 1.0)


def test_op9_merges_parts(spark):
    """The sketch of a whole is that of its parts' sketches, exactly."""
    words = [f"w{i % 700}" for i in range(2000)]
    cut = 900
    row = spark.createDataFrame([(" ".join(words), " ".join(words[: cut + 4]), " ".join(words[cut:]))], "whole string, a string, b string")
    both = row.select(sketches.sketch(F.col("whole")).alias("whole"), sketches.merge(sketches.sketch(F.col("a")), sketches.sketch(F.col("b"))).alias("merged")).first()
    assert both.whole == both.merged
