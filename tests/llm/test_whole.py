"""Operators against plain versions where lists, vocabularies and texts are long, and rows of one id that differ."""

import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from quarry.llm import near_dup, repeats, secret_scan, url_filter
from quarry.llm.common import table
from test_contracts import SF, plain_components, plain_sets


def test_op2_families_of_near_copies(spark):
    """Families whose copies are linked only through each other, and unlike texts that share a passage."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for length, copies, least, most in ((200, 250, 6, 15), (60, 60, 1, 6)):
        base = [r.choice(vocabulary) for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            for _ in range(r.randint(least, most)):
                words[r.randrange(length)] = r.choice(vocabulary)
            texts.append(" ".join(words))
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 60))) + " " + passage for _ in range(80)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    want = plain_components(plain_sets(rows, 2))
    got = near_dup.near_dup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=2).collect()
    assert {x.doc_id: x.component_id for x in got} == want
    assert len(set(want.values())) > 50


def test_op7_verdicts_against_a_plain_version(spark):
    pages = table(spark, SF, "pages").select("page_id", "url").union(spark.createDataFrame([(-1, "http://spamfarm.example.info/cheap/pills"), (-2, "http://docshelp.example.info/learn/x1"), (-3, None)], "page_id long, url string"))
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    verdict_of = {rule: v for v, rule in url_filter.RULES}
    tokens = lambda t: re.findall("[a-z]+|[0-9]+", t.lower())
    counts = Counter(t for r in got.values() for t in tokens(r.path) if t[0].isalpha())
    top = max(counts.values())
    for w in url_filter.WEB_WORDS:
        counts[w] += max(1, top // 4)
    segmenter = url_filter.Segmenter(counts)

    def words(r):
        names = tokens(r.host)
        out = [w for n in (names[:-1] if len(names) > 1 else names) for w in (["0"] if n[0].isdigit() else segmenter.words(n))]
        return out + [f"host:{n}" for n in names[-1:]] + [f"path:{'0' if t[0].isdigit() else t}" for t in tokens(r.path)]

    by = {v: Counter({w: url_filter.CUE_WEIGHT for w in cues}) for v, cues in url_filter.CUES.items()}
    seen = Counter()
    for r in got.values():
        if r.rule:
            by[verdict_of[r.rule]].update(words(r))
            seen[verdict_of[r.rule]] += 1
    known = set(by["block"]) | set(by["allow"])
    odds = {w: math.log((by["block"][w] + 1) / (by["block"].total() + len(known) + 1)) - math.log((by["allow"][w] + 1) / (by["allow"].total() + len(known) + 1)) for w in known}
    for r in got.values():
        score = math.log(seen["block"] + 1) - math.log(seen["allow"] + 1) + sum(odds.get(w, 0.0) for w in words(r))
        assert r.score == pytest.approx(score, abs=1e-6)
        assert r.verdict == (verdict_of[r.rule] if r.rule else "block" if r.score > 0 else "allow")


def test_op4_letters_only_after_a_cue(spark):
    texts = [(1, "please use pwd: correcthorse today"), (2, "the correcthorse ran over the hill"), (3, "note: everything is as it was"), (4, "see the login pages of the archive")]
    got = {r.doc_id: r.spans for r in secret_scan.secret_rows(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "crf:16:28", 2: "", 3: "", 4: ""}


def test_op4_file_features_are_learned():
    model = secret_scan.fit()
    slots = [secret_scan.features("x", [], [], f)[9] for f in ("00", "03", "10", "30")]
    assert all(abs(model.emit[s]).sum() > 0 for s in slots) and len(set(slots)) == 4


def test_op8_long_texts_and_blocks_of_any_size(spark, monkeypatch):
    """A passage in texts of a few bytes and of megabytes, and stretches shorter than a text."""
    r = random.Random(5)
    letters = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage = letters(3000)
    texts = [(1, letters(40) + passage[:150]), (2, letters(3_000_000) + passage + letters(100)), (3, passage[20:140]), (4, letters(700_000) + passage[1000:])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.n_removed for x in repeats.digest_rows(df).collect()}
    assert got == {1: 0, 2: 150, 3: 120, 4: 2000}
    import numpy as np

    from quarry.llm import words as W

    data = np.frombuffer(texts[3][1][:200_000].encode(), np.uint8)
    offsets = np.array([0, 50_000, 50_000, 200_000])
    whole = [np.concatenate([np.repeat(a, hi - lo + 1)[None] for lo, hi, a in zip(*repeats.anchors(data, offsets, 100, W.Ranges(data)))], axis=1) for _ in (0,)][0]
    monkeypatch.setattr(repeats, "STRETCH", 7_001)
    parts = np.concatenate([np.repeat(a, hi - lo + 1)[None] for lo, hi, a in zip(*repeats.anchors(data, offsets, 100, W.Ranges(data)))], axis=1)
    assert (whole == parts).all()


def test_rows_of_one_id_with_different_texts(spark):
    """op2 judges each row by its own text; the pipeline's second stage keeps one row of each such id."""
    rows = [(1, "alpha beta gamma delta epsilon"), (1, "zeta eta theta iota kappa"), (2, "zeta eta theta iota kappa"), (3, "nothing like any of them at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in near_dup.near_dup(df, size=2).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (3, 3): 1}
    left = corpus_pipeline.near_dedup(spark, df, SF).select("doc_id").collect()
    assert sorted(r.doc_id for r in left) == [1, 3]
