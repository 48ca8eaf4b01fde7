"""Stable hashes: the only source of randomness in this library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GLOBAL_SEED = 20260716
SEPARATOR = "\x1f"


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def seed64(*parts) -> Column:
    """First 8 bytes, big-endian, of the SHA-256 over the parts joined by 0x1f; decimal(20,0), as it is unsigned."""
    joined = F.concat_ws(SEPARATOR, *(_text(p) for p in parts))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def unit(*parts) -> Column:
    """A number in [0, 1) from the parts."""
    return seed64(*parts).cast("double") / F.lit(2.0**64)


def stable_bin(key: Column, bins: list[str]) -> Column:
    """One of the bins, by seed modulo their number."""
    at = (seed64(key) % len(bins)).cast("int")
    return F.element_at(F.array(*map(F.lit, bins)), at + 1)


def content_key(model, prompt, text, context) -> Column:
    """Cache key of one enrichment: its model, prompt, text and context; missing text counts as empty."""
    filled = [F.coalesce(_text(p), F.lit("")) for p in (model, prompt, text, context)]
    return F.sha2(F.concat_ws("\x00", *filled), 256)


def guid(given: Column, text: Column) -> Column:
    """The record's own id, or the SHA-256 of its text."""
    return F.coalesce(given.cast("string"), F.sha2(text, 256))
