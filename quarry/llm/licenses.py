"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, and a
shunting-yard parser evaluates licence expressions.

Words are runs of letters a to z (A to Z lower-cased), digits and characters beyond ASCII. Phrases
are found as consecutive words: the text's words, parted by single spaces, run through one automaton
of all phrases. Identifier tags (`SPDX-License-Identifier:` and the like) are found by a second
automaton in the lower-cased text; what follows a tag on its line is parsed as a licence expression,
with `or` binding weaker than `and`, `and` weaker than `with`, and parentheses.

A document's labels are the distinct labels of its phrases and of all licences its expressions name.
The score is the share of what was found: 1 where a base phrase or a valid expression stands, else
the best weight of the other phrases found, else 0. ``allowed`` tells whether an expression can be
met with a given set of licences.

Edge cases: a null or empty text has no words and no labels (empty strings, nulls for places). An
expression that does not parse gives no label. Overlapping phrases all count. Repeated rows give
equal results. Texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import annotate, blocks

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notice phrases, their labels and weights.
NOTICES = {
    "mit license": ("mit", 0.7),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "gnu general public license": ("gpl", 0.8),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "mozilla public license version 2": ("mpl-2", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.7),
    "apache license": ("apache", 0.7),
    "creative commons attribution": ("cc-by", 0.7),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "creative commons zero": ("cc0", 0.8),
    "all rights reserved": ("all-rights-reserved", 0.5),
    "public domain": ("public-domain", 0.4),
}
# Identifier tags; an expression follows on the same line.
TAGS = ("spdx-license-identifier:", "license-expression:", "licence-expression:")

#: Every byte that is no word byte becomes a space, capitals their small letters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
IN_WORD = np.array([b != 32 for b in FOLD])
OPERATORS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+\-]*")

FIELDS = [
    ("n_words", T.LongType(), pa.int64()),
    ("places", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType())])), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))),
    ("expressions", T.ArrayType(T.StringType()), pa.list_(pa.string())),
    ("labels", T.StringType(), pa.string()),
    ("score", T.DoubleType(), pa.float64()),
]


def postfix(text: str) -> list[str]:
    """A licence expression in postfix order, by the shunting yard; ValueError if it is none."""
    rest = _TOKEN.sub(" ", text.lower()).strip()
    if rest:
        raise ValueError(f"not part of an expression: {rest[:20]!r}")
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether the last token ended an operand
    for token in _TOKEN.findall(text.lower()):
        if token == "(":
            if operand:
                raise ValueError("an operator is missing before (")
            waiting.append(token)
        elif token == ")":
            if not operand:
                raise ValueError("an operand is missing before )")
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("a ) too many")
            waiting.pop()
        elif token in OPERATORS:
            if not operand:
                raise ValueError(f"an operand is missing before {token}")
            while waiting and OPERATORS.get(waiting[-1], 0) >= OPERATORS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = False
        else:
            if operand:
                raise ValueError("an operator is missing")
            out.append(token)
            operand = True
    if not operand:
        raise ValueError("an operand is missing at the end")
    if "(" in waiting:
        raise ValueError("a ( too many")
    return out + waiting[::-1]


def licences(parsed: list[str]) -> set[str]:
    """The licences of an expression; a licence with an exception is one of its own."""
    stack: list[set[str]] = []
    for token in parsed:
        if token in OPERATORS:
            b, a = stack.pop(), stack.pop()
            stack.append({f"{x} with {y}" for x in a for y in b} if token == "with" else a | b)
        else:
            stack.append({token})
    return stack.pop()


def allowed(parsed: list[str], permitted: Iterable[str]) -> bool:
    """Whether the expression can be met with the permitted licences alone."""
    permitted = set(permitted)
    stack: list[tuple[bool, str]] = []
    for token in parsed:
        if token in OPERATORS:
            (b, name_b), (a, name_a) = stack.pop(), stack.pop()
            if token == "with":
                name = f"{name_a} with {name_b}"
                stack.append((name in permitted or a, name))
            else:
                stack.append((a or b if token == "or" else a and b, ""))
        else:
            stack.append((token in permitted, token))
    return stack.pop()[0]


def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Of phrases, whose values are (phrase length, label, weight, base), and of tags."""
    phrases: dict[str, list] = {}
    for phrase, label in BASE.items():
        phrases.setdefault(phrase, []).append((label, 1.0, True))
    for phrase, (label, weight) in NOTICES.items():
        phrases.setdefault(phrase, []).append((label, weight, False))
    notices, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, found in phrases.items():
        notices.add_word(f" {phrase} ", (len(phrase), found))
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    notices.make_automaton()
    tags.make_automaton()
    return notices, tags


def scan_licenses(docs: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Every row of docs with n_words, places of notices, expressions, labels and score."""

    def make():
        notices, tags = automata()

        def one(raw: bytes) -> tuple[list[dict], list[str], str, float]:
            folded = " " + b" ".join(raw.translate(FOLD).split()).decode("utf-8", "replace") + " "
            places, labels, score = [], set(), 0.0
            word, seen = 0, 0  # words that start before place ``seen``
            for end, (length, found) in notices.iter(folded):
                start = end - length - 1  # of the space before the phrase
                if start >= seen:
                    word += folded.count(" ", seen, start)
                    seen = start
                    at = word
                else:
                    at = word - folded.count(" ", start, seen)
                for label, weight, base in found:
                    places.append({"word": at, "label": label, "base": base})
                    labels.add(label)
                    score = max(score, weight)
            expressions = []
            low = raw.lower()
            if any(tag in low for tag in _TAG_BYTES):
                text = raw.decode("utf-8", "replace")
                for end, _ in tags.iter(text.translate(_LOW)):
                    line = text[end + 1 :].split("\n", 1)[0].strip(" \t\r*/#->")
                    try:
                        parsed = postfix(line)
                    except ValueError:
                        continue
                    expressions.append(line)
                    labels |= licences(parsed)
                    score = 1.0
            return sorted(places, key=lambda p: p["word"]), expressions, ",".join(sorted(labels)), score

        def work(batch):
            counts, rest = [], []
            for row, end, data, offsets in blocks(batch, "text"):
                start, _ = W.runs(IN_WORD[data], offsets)
                first = np.searchsorted(start, offsets)
                counts += np.diff(first).tolist()
                whole = data.tobytes()
                rest += [one(whole[a:b]) if n > 1 else ([], [], "", 0.0) for a, b, n in zip(offsets[:-1], offsets[1:], np.diff(first))]
            return [counts, *([r[i] for r in rest] for i in range(4))]

        return work

    return annotate(docs, FIELDS, make, names)


_LOW = {c: c + 32 for c in range(65, 91)}
_TAG_BYTES = tuple(t.encode() for t in TAGS)


def license_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each document."""
    base = F.filter("places", lambda p: p["base"])
    at = F.transform(base, lambda p: p["word"])
    return scan_licenses(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"]))), ",").alias("base_labels"),
        "labels",
        "score",
    )
