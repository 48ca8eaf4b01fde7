"""Secret scans: three base patterns, and a linear-chain conditional random field for the rest.

The field tags a text's tokens (runs without white space) as B (a secret begins), I (it goes on) or O.
Its features are hashed: the token's shape, length, entropy, alphabet and known beginnings; the
words before and after it; and the file's shares of symbols and of tokens with digits. Weights are
fitted here, on the driver, by stochastic gradient steps on the log-likelihood of generated lines
(a fixed seed and number), each in a generated file whose shares are its own, and decoded by Viterbi.

Every token is scored, and decoding is exact. All tokens of a block are scored at once, out of a table
of its distinct ones (``Table``). A token is left to O without decoding only where no stretch of B and I
that holds it can score above the same stretch of O (``undecided``); between such tokens the most likely
tags do not depend on each other, so decoding run by run of the others gives the same tags as decoding
the whole text at once, and the words around a run still enter its features.

Spans are (kind, start, end) in code points, end exclusive: ``assign``, ``access``, ``hex`` of the
base patterns, leftmost and non-overlapping for each kind, and ``crf`` for tagged spans that touch no
base span, without quotes and punctuation around them.

Edge cases: a null or empty text has no spans. Texts of any length are scanned whole. Repeated rows
give equal results.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import annotate, blocks

KINDS = ("assign", "access", "hex", "crf")
_ANY = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
# The base patterns and the least length of what they must take.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(rf"({'|'.join(map(_ANY, KEYWORDS))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
_HINTS = tuple(k.encode() for k in ("password", "passwd", "secret", "token", "apikey", "api_key"))

HEX_BYTE = np.zeros(256, bool)
HEX_BYTE[list(b"0123456789abcdef")] = True
DIGIT = np.zeros(256, bool)
DIGIT[list(b"0123456789")] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>{}[]();=")] = True

#: Hashed features, and generated training lines.
SLOTS, LINES, ROUNDS = 1 << 13, 1100, 5
# Words that stand before a secret.
CUES = ("bearer", "credential", "credentials", "auth", "key", "pwd", "pass", "access", "private", "signature", "login", "password", "passwd", "secret", "token")
TAGS = "BIO"
#: Distinct tokens that a task keeps from block to block, and what sums of scores may differ by.
KNOWN, SLACK = 500_000, 0.01
ALPHABETS = ("hex", "digits", "base64", "mixed")
_EDGE = "\"'`,;.:!?()[]{}<>#*$%&"

FIELDS = [
    ("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
]


def base_spans(text: str, hinted: bool = True, hexed: bool = True) -> list[tuple[str, int, int]]:
    """Matches of the base patterns, by start and kind."""
    found = []
    if hinted:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if hexed:
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def shape(token: str) -> str:
    """A token's character classes, runs shortened to one."""
    classes = "".join("d" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token)
    return re.sub(r"(.)\1+", r"\1", classes)[:12]


_WEIGHED = [k * math.log2(max(1, k)) for k in range(65)]


def _entropy(token: str) -> int:
    """Entropy of a token's characters in half bits, rounded down."""
    size = len(token)
    if size < len(_WEIGHED):
        spent = sum([_WEIGHED[k] for k in map(token.count, set(token))])
    else:
        spent = sum(k * math.log2(k) for k in Counter(token).values())
    return int(2 * (math.log2(size) - spent / size) + 1e-9)


def _word(token: str) -> str:
    return re.sub(r"[^a-z]", "", token.lower())[:12]


_HEX, _BASE64 = re.compile("[0-9a-f]+|[0-9A-F]+"), re.compile("[A-Za-z0-9+/=_-]+")


def alphabet_of(core: str) -> str:
    return "hex" if _HEX.fullmatch(core) else "digits" if core.isdigit() else "base64" if _BASE64.fullmatch(core) else "mixed"


def features(token: str, before: list[str], after: list[str], file: str) -> np.ndarray:
    """Hashed features of a token between its neighbours."""
    core = token.strip(_EDGE)
    alphabet = alphabet_of(core)
    runs = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:]))
    found = [
        "bias",
        f"shape={shape(core)}",
        f"length={min(len(core) // 4, 16)}",
        f"entropy={_entropy(core) if core else 0}",
        f"alphabet={alphabet}",
        f"alphabet+length={alphabet}{min(len(core) // 8, 6)}",
        f"switches={min(runs // 2, 6)}+{alphabet}",
        f"head={core[:4].lower()}",
        f"has={'@' in core}{'.' in core}{'/' in core}{'-' in core}{':' in core}",
        f"file={file}",
        f"marks={token[len(token.rstrip(_EDGE)):][:2]}",
    ]
    found += [f"before{i}={_word(t)}" for i, t in enumerate(before[::-1][:3])]
    found += [f"after{i}={_word(t)}" for i, t in enumerate(after[:2])]
    if before:
        assigned = before[-1][-1:] in (":", "=")
        named = next((w for w in map(_word, before[:-3:-1]) if w), "")
        found += [f"assigned={assigned}", f"named={named}{assigned}", f"cued={named in CUES}{assigned}", f"cued={named in CUES}{assigned}{alphabet}"]
    return np.array([zlib.crc32(f.encode()) % SLOTS for f in found])


def file_features(symbols: int, size: int, digits: int, tokens: int) -> str:
    """A file's shares of symbols among its bytes, by twentieths, and of tokens with a digit, by tenths, both up to three."""
    return f"{min(3, symbols * 20 // max(1, size))}{min(3, digits * 10 // max(1, tokens))}"


def file_of(tokens: list[str]) -> str:
    raw = " ".join(tokens).encode()
    return file_features(sum(map(bool, SYMBOL[list(raw)])), len(raw), sum(any(c in "0123456789" for c in t) for t in tokens), len(tokens))


def _files(seed: int = 11) -> list[tuple[list[str], list[int], str]]:
    """Generated training lines: tokens, tags and file features, with secrets and with things that only look like them."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[rng.integers(len(options))]
    chars = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: chars(lower, int(rng.integers(2, 10)))
    mixed = lambda n: chars(lower + upper + digits, n - 2) + pick(digits) + pick(upper)
    number = lambda a, b: str(rng.integers(a, b))
    long_word = lambda: chars(lower, int(rng.integers(8, 16)))
    ends = ["", "", "", "", ",", ".", "!!", "?"]

    def prose(n: int) -> list[str]:
        """Words as sentences have them, or all in capitals."""
        loud = rng.random() < 0.15
        out = []
        for _ in range(n):
            w = "is" if rng.random() < 0.12 else chars(lower, int(rng.integers(1, 14)))
            out.append((w.upper() if loud or rng.random() < 0.05 else w.capitalize() if not out or out[-1][-1] in ".!?" or rng.random() < 0.1 else w) + pick(ends))
        return out

    # How well-known keys begin.
    secrets = [
        lambda: "ghp_" + mixed(36),
        lambda: "sk_live_" + mixed(24),
        lambda: "sk-" + mixed(40),
        lambda: "xoxb-" + number(10**10, 10**11) + "-" + mixed(24),
        lambda: "eyJ" + mixed(30) + "." + mixed(40),
        lambda: "AIza" + mixed(35),
        lambda: "glpat-" + mixed(20),
        lambda: mixed(int(rng.integers(20, 44))),
        lambda: chars("0123456789abcdef", int(rng.integers(24, 31))),
    ]
    cues = CUES[:11]
    # What the rest of a file looks like: prose, settings, records.
    around = [
        lambda: word(),
        lambda: pick(["{", "}", "};", "(", ");", "[]", f"{word()}={word()};", f"#{word()}", f"${word()}"]),
        lambda: pick([number(1, 10**6), f"{word()}{number(1, 99)}", f"{number(10, 24)}:{number(10, 60)}"]),
    ]
    benign = [
        lambda: number(10**7, 10**16),
        lambda: f"{number(1990, 2030)}-{number(10, 13)}-{number(10, 29)}",
        lambda: ".".join(number(1, 256) for _ in range(4)),
        lambda: f"{word()}.{number(1, 99)}@{word()}.example.com",
        lambda: f"{word()}{word()}.{number(1, 99)}@{word()}{number(1, 9)}.example.com",
        lambda: "".join(word() + pick("éñóäü") for _ in range(4)) + pick([",", ".", "", "###", "***"]),
        lambda: f"https://{word()}.example.com/{word()}/{number(1, 999)}?page={number(1, 9)}",
        lambda: f"{number(200, 999)}-{number(200, 999)}-{number(1000, 9999)}",
        lambda: f"v{number(1, 20)}.{number(0, 20)}.{number(0, 99)}",
        lambda: f"{word()}{number(1, 999)}{word()}",
        lambda: f"{word()}-{word()}-{number(1, 99)}",
        lambda: "".join(word() for _ in range(4)) + pick(["###", "***", "$$$", "!!"]),
        lambda: f"{chars('0123456789abcdef', 8)}-{chars('0123456789abcdef', 4)}-4{chars('0123456789abcdef', 3)}",
        lambda: f"${number(1, 99)},{number(100, 999)}.{number(10, 99)}",
    ]
    around = [[make() for _ in range(200)] for make in around]
    out = []
    for i in range(LINES):
        tokens = prose(int(rng.integers(2, 7)))
        tags = [2] * len(tokens)
        if i % 9 == 0:  # a key that goes on over lines
            tokens += ["PRIVATE", "KEY-----", *(mixed(64) for _ in range(3))]
            tags += [2, 2, 0, 1, 1]
        elif i % 9 == 1:  # letters only, told by what stands before them
            tokens += [pick(cues) + pick([":", "=", " =", " is"])]
            tokens = [t for token in tokens for t in token.split()]
            tags += [2] * (len(tokens) - len(tags))
            tokens.append(pick(['"', "", "'"]) + long_word() + pick(["", '"', ","]))
            tags.append(0)
        elif i % 9 in (3, 5):  # and what is none, after a colon or in running text
            tokens += [*pick([word() + ":", word() + "=", word() + " is", pick(cues)]).split(), pick([long_word, long_word, pick(benign)])() + pick(["", ",", "."])]
            tags += [2] * (len(tokens) - len(tags))
        elif i % 2:
            tokens += [pick(cues) + pick(["", ":", "=", " is", " ="])] if i % 4 == 1 else []
            tokens = [t for token in tokens for t in token.split()]
            tags += [2] * (len(tokens) - len(tags))
            tokens.append(pick(['"', "", "'"]) + pick(secrets)() + pick(["", '"', ",", "."]))
            tags.append(0)
        for _ in range(rng.integers(0, 4)):
            tokens.append(pick(benign)())
            tags.append(2)
        tokens += prose(int(rng.integers(0, 4)))
        tags += [2] * (len(tokens) - len(tags))
        style = around[int(rng.choice(3, p=[0.3, 0.4, 0.3] if 0 in tags else [0.6, 0.2, 0.2]))]
        rest = [*pick([around[0], style])[: rng.integers(10, 60)], *style[: rng.integers(0, 60)]]
        out.append((tokens, tags, file_of(tokens + rest)))
    return out


def _lines(seed: int = 11) -> list[tuple[list[str], list[int]]]:
    return [(tokens, tags) for tokens, tags, _ in _files(seed)]


class Field:
    """A linear-chain field over three tags: emission weights, transitions, and whole-sequence decoding."""

    def __init__(self):
        self.emit, self.move = np.zeros((SLOTS, 3)), np.zeros((3, 3))
        self.move[2, 1] = -8.0  # a secret does not go on where none began
        self.start = np.array([0.0, -8.0, 0.0])

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        return np.array([self.emit[f].sum(axis=0) for f in found])

    def fit(self, lines: list[tuple[list[np.ndarray], list[int]]], rounds: int = ROUNDS, rate: float = 0.15) -> Field:
        for turn in range(rounds):
            step = rate / (1 + turn)
            for found, tags in lines:
                s, n = self.scores(found), len(tags)
                forth, back = np.zeros((n, 3)), np.zeros((n, 3))
                forth[0] = self.start + s[0]
                for i in range(1, n):
                    forth[i] = np.logaddexp.reduce(forth[i - 1][:, None] + self.move, axis=0) + s[i]
                for i in range(n - 2, -1, -1):
                    back[i] = np.logaddexp.reduce(self.move + s[i + 1] + back[i + 1], axis=1)
                total = np.logaddexp.reduce(forth[-1])
                grad = -np.exp(forth + back - total)
                grad[np.arange(n), tags] += 1
                for i, f in enumerate(found):
                    np.add.at(self.emit, f, step * grad[i])
                for i in range(1, n):
                    pair = forth[i - 1][:, None] + self.move + s[i] + back[i]
                    move = -np.exp(pair - total)
                    move[tags[i - 1], tags[i]] += 1
                    self.move += step * move
            self.emit *= 1 - 0.01 * step
        return self

    def decode(self, found: list[np.ndarray], from_o: bool) -> list[int]:
        """The most likely tags of a run of tokens after a token that is O, or at a text's start."""
        s = self.scores(found)
        best = (self.move[2] if from_o else self.start) + s[0]
        back = []
        for i in range(1, len(s)):
            step = best[:, None] + self.move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + s[i]
        best = best + self.move[:, 2]  # what follows a run is O, or the end, which is no different
        tags = [int(best.argmax())]
        for b in back[::-1]:
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def fit() -> Field:
    """The field, fitted on the generated lines."""
    lines = []
    for tokens, tags, file in _files():
        lines.append(([features(t, tokens[max(0, i - 3) : i], tokens[i + 1 : i + 3], file) for i, t in enumerate(tokens)], tags))
    return Field().fit(lines)


class Table:
    """Scores of a field's features for distinct tokens, so that all tokens of a block are scored by look-up.

    Beside what a token says of itself, it has slots for what it says of those after and before it.
    """

    def __init__(self, field: Field):
        self.emit = field.emit
        slot = lambda feature: zlib.crc32(feature.encode()) % SLOTS
        self.heads = [zlib.crc32(f.encode()) for f in ("before0=", "before1=", "before2=", "after0=", "after1=", "named=")]
        flags = (False, True)
        self.assigned = self.emit[[slot(f"assigned={a}") for a in flags]]
        self.unnamed = np.array([slot(f"named={a}") for a in flags])
        self.cued = np.array([[[self.emit[[slot(f"cued={c}{a}"), slot(f"cued={c}{a}{x}")]].sum(axis=0) for x in ALPHABETS] for a in flags] for c in flags])
        # Every token's parts are features without neighbours; those of a file are added for each text.
        self.sums: dict[tuple, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.own, self.slots, self.flags = np.empty((0, 3), np.float32), np.empty((0, 7), np.int16), np.empty((0, 4), np.int8)
        self.sums.clear()

    def _own(self, token: str, core: str, alphabet: str) -> np.ndarray:
        """Sum of the features of a token by itself; those that many tokens share are summed once."""
        if core.isalpha() and core.islower():
            form, runs, has = "a", 0, "FalseFalseFalseFalseFalse"
        else:
            form, runs = shape(core), sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:]))
            has = f"{'@' in core}{'.' in core}{'/' in core}{'-' in core}{':' in core}"
        size, n = len(core), _entropy(core) if core else 0
        key = form, min(size // 4, 16), min(size // 8, 6), n, alphabet, min(runs // 2, 6), has, token[len(token.rstrip(_EDGE)) :][:2]
        if key not in self.sums:
            found = ["bias", f"shape={form}", f"length={key[1]}", f"entropy={n}", f"alphabet={alphabet}", f"alphabet+length={alphabet}{key[2]}", f"switches={key[5]}+{alphabet}", f"has={has}", f"marks={key[7]}"]
            self.sums[key] = self.emit[[zlib.crc32(f.encode()) % SLOTS for f in found]].sum(axis=0)
        return self.sums[key] + self.emit[zlib.crc32(f"head={core[:4].lower()}".encode()) % SLOTS]

    def at(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows of tokens, with new ones put in."""
        if len(self.rows) > KNOWN:
            self.clear()
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        known, found = self.rows, distinct.tolist()
        new = [i for i, h in enumerate(found) if h not in known]
        own, slots, flags, heads, crc32 = [], [], [], [*self.heads, self.heads[5]], zlib.crc32
        for i, a, b in zip(new, start[first[new]].tolist(), end[first[new]].tolist()):
            known[found[i]] = len(known)
            token = data[a:b].tobytes().decode("utf-8", "replace")
            core, word = token.strip(_EDGE), _word(token)
            alphabet = alphabet_of(core)
            raw = word.encode()
            own.append(self._own(token, core, alphabet))
            slots.append([crc32(x, h) % SLOTS for x, h in zip((raw, raw, raw, raw, raw, raw + b"False", raw + b"True"), heads)])
            flags.append((ALPHABETS.index(alphabet), bool(word), word in CUES, token[-1] in ":="))
        if new:
            self.own, self.slots, self.flags = (np.concatenate([x, np.array(y, x.dtype)]) for x, y in ((self.own, own), (self.slots, slots), (self.flags, flags)))
        return np.array([known[h] for h in found])[where]

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, files: list[str]) -> np.ndarray:
        """The scores of tokens; those of a text are first to first of the next."""
        n, texts = len(start), np.diff(first)
        rows = self.at(W.Ranges(data)(start, end), data, start, end)
        place = np.arange(n) - np.repeat(first[:-1], texts)
        left = np.repeat(texts, texts) - place
        s = self.own[rows].astype(np.float64) + np.repeat(self.emit[[zlib.crc32(f"file={f}".encode()) % SLOTS for f in files]], texts, axis=0)
        slots, flags = self.slots[rows], self.flags[rows].astype(np.int64)
        for k in range(3):
            at = np.flatnonzero(place > k)
            s[at] += self.emit[slots[at - k - 1, k]]
        for k in range(2):
            at = np.flatnonzero(left > k + 1)
            s[at] += self.emit[slots[at + k + 1, 3 + k]]
        at = np.flatnonzero(place > 0)
        assigned = flags[at - 1, 3]
        second = (flags[at - 1, 1] == 0) & (place[at] > 1)
        by = at - 1 - second  # the token whose word names this one; where it has none either, no word does
        named = np.where(flags[by, 1] > 0, slots[by, 5 + assigned], self.unnamed[assigned])
        s[at] += self.assigned[assigned] + self.emit[named] + self.cued[flags[by, 2], assigned, flags[at, 0]]
        return s


def undecided(field: Field, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Tokens that may be other than O in the most likely tags; those of a text are first to first of the next.

    A stretch of B and I that becomes O gains each token's own difference, and loses what entering, going
    on and leaving are better than staying in O at most. Where every stretch through a token gains,
    it is O. The best stretch through a token comes from running sums up to it and from it on.
    """
    move, start = field.move - field.move[2, 2], field.start - field.start[2]
    enter, inner, leave = max(start[:2].max(), move[2, :2].max()), move[:2, :2].max(), move[:2, 2].max()
    gain = scores[:, 2] - scores[:, :2].max(axis=1) - inner
    # No stretch goes from one text into the next.
    wall = np.zeros(len(gain) + 1)
    np.add.at(wall, first, 1.0)
    wall = np.cumsum(np.minimum(wall, 1.0))[:-1] * (2 * np.abs(gain).max(initial=0.0) * max(1, int(np.diff(first).max(initial=0))) + abs(enter) + abs(leave) + abs(inner) + 1)
    sums = np.cumsum(gain)
    before = np.maximum.accumulate(sums - gain + wall)
    after = np.minimum.accumulate((sums + wall)[::-1])[::-1]
    return after - before < enter + leave - inner + SLACK


def scan_secrets(docs: DataFrame, field: Field | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Every row of docs with spans: structs of kind, start and end, by start and kind."""
    field = field or fit()
    used = np.flatnonzero(np.abs(field.emit).sum(axis=1))
    packed = used, field.emit[used].astype(np.float32), field.move, field.start

    def make():
        model = Field()
        model.emit[packed[0]], model.move, model.start = packed[1], packed[2], packed[3]
        known = Table(model)

        def tagged(raw: bytes, start: np.ndarray, end: np.ndarray, open_: np.ndarray, file: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
            """Spans of the runs of undecided tokens of a text."""
            points = np.concatenate([[0], np.cumsum(W.HEAD[np.frombuffer(raw, np.uint8)])])
            token = lambda i: raw[start[i] : end[i]].decode("utf-8", "replace")
            out, at = [], np.flatnonzero(open_)
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                lo, hi = int(run[0]), int(run[-1])
                around = [token(i) for i in range(max(0, lo - 3), min(len(start), hi + 3))]
                shift = lo - max(0, lo - 3)
                texts = around[shift : shift + len(run)]
                found = [features(t, around[max(0, shift + i - 3) : shift + i], around[shift + i + 1 : shift + i + 3], file) for i, t in enumerate(texts)]
                tags = model.decode(found, lo > 0)
                i = 0
                while i < len(tags):
                    if TAGS[tags[i]] == "O":
                        i += 1
                        continue
                    j = i + 1
                    while j < len(tags) and TAGS[tags[j]] == "I":
                        j += 1
                    first, last = texts[i], texts[j - 1]
                    a = int(points[start[lo + i]]) + len(first) - len(first.lstrip(_EDGE))
                    b = int(points[end[lo + j - 1]]) - (len(last) - len(last.rstrip(_EDGE)))
                    if a < b and not any(a < y and x < b for _, x, y in base):
                        out.append(("crf", a, b))
                    i = j
            return out

        def work(batch):
            rows = []
            for _, _, data, offsets in blocks(batch, "text"):
                start, end, first = W.words(data, offsets)
                digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
                has = digits[end] - digits[start]
                symbols, size = W.totals(SYMBOL[data], offsets), np.diff(offsets)
                counted = np.concatenate([[0], np.cumsum(has > 0)])
                files = [file_features(*x) for x in zip(symbols.tolist(), size.tolist(), (counted[first[1:]] - counted[first[:-1]]).tolist(), np.diff(first).tolist())]
                open_ = undecided(model, known.scores(data, start, end, first, files), first) if len(start) else np.zeros(0, bool)
                opened = np.concatenate([[0], np.cumsum(open_)])
                a, b = W.runs(HEX_BYTE[data], offsets)
                long = a[b - a >= LEAST["hex"]]
                hexed = np.searchsorted(long, offsets)
                whole = data.tobytes()
                for i, n in enumerate(size):
                    if not n:
                        rows.append([])
                        continue
                    lo, hi = first[i], first[i + 1]
                    raw = whole[offsets[i] : offsets[i + 1]]
                    low = raw.lower()
                    hinted = (b":" in low or b"=" in low) and any(h in low for h in _HINTS)
                    hexes = hexed[i + 1] > hexed[i]
                    spans = base_spans(raw.decode("utf-8", "replace"), hinted, hexes) if hinted or hexes or b"AKIA" in raw else []
                    if opened[hi] > opened[lo]:
                        spans = spans + tagged(raw, start[lo:hi] - offsets[i], end[lo:hi] - offsets[i], open_[lo:hi], files[i], spans)
                    rows.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))])
            return [rows]

        return work

    return annotate(docs, FIELDS, make, names)


def secret_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(docs.select("doc_id", "text")).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
