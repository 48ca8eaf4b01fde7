"""Interfaces to models and tokenizers, with offline, deterministic stand-ins.

A tokenizer is a function of a text column to an array; an encoder one to a vector; a translator one
to a text; a judge gives a critique and a score. Production code passes its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as X

Text = Callable[[Column], Column]

#: Tokenizers by name.
TOKENIZERS: dict[str, Text] = {"whitespace": X.words, "script": X.script_tokens, "unicode": X.unicode_tokens}


def tokenizer(name: str) -> Text:
    if name not in TOKENIZERS:
        raise KeyError(f"no tokenizer is named {name}; there are {', '.join(sorted(TOKENIZERS))}")
    return TOKENIZERS[name]


def encode(text: Column, dims: int = 32) -> Column:
    """A hashed bag of words at length 1: what a text's vector is where no encoder is given."""
    from quarry.functions.vectors import normalise

    once = lambda value, use: F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))
    # What stands in a lambda is computed for each element, so the tokens and their counts are bound before.
    hashed = F.transform(X.unicode_tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    counts = once(hashed, lambda hs: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(hs, lambda h: h == d)).cast("double")))
    return once(counts, normalise)


def translate(text: Column) -> Column:
    """A stand-in translation: the text in capitals."""
    return F.upper(text)


def judge(source: Column, translated: Column) -> Column:
    """(critique, score 0 to 5) by rule: blank 0, far too short or long 2, numbers lost 3, else 5."""
    ratio = X.length_ratio(F.coalesce(translated, F.lit("")), source)
    lost = F.size(F.array_except(X.numbers(source), X.numbers(translated))) > 0
    blank = translated.isNull() | (F.trim(translated) == "")
    score = F.when(blank, 0).when((ratio < 0.5) | (ratio > 2.0), 2).when(lost, 3).otherwise(5)
    critique = F.when(blank, "blank").when((ratio < 0.5) | (ratio > 2.0), "length").when(lost, "numbers").otherwise("fine")
    return F.struct(critique.alias("critique"), score.alias("score"))


# Names of models and the kind of service that answers for them; the first that matches.
ROUTES = (("^(gpt|o[0-9])", "openai"), ("^claude", "anthropic"), ("^gemini", "google"), ("^(meta-llama|qwen)/", "together"), ("/", "openrouter"))


def route(model: str) -> str:
    """The service that answers for a model's name."""
    for pattern, service in ROUTES:
        if re.search(pattern, model.lower()):
            return service
    raise KeyError(f"no service answers for {model}")


def routed(model: Column) -> Column:
    """The service of each row's model; null where none answers."""
    name, out = F.lower(model), F.lit(None).cast("string")
    for pattern, service in reversed(ROUTES):
        out = F.when(name.rlike(pattern), service).otherwise(out)
    return out
