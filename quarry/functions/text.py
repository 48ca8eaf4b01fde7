"""Text as columns: tokens, counts, numbers, paragraphs and small rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the lexical tokenizer drops (vowel points and quotes) and takes (runs of one script).
VOWEL_POINTS = "[\\u0591-\\u05C7]"
QUOTES = "[\\u05F3\\u05F4'\"]"
SCRIPT_RUN = "([\\u05D0-\\u05EA]+|[A-Za-z]+|\\p{Nd}+)"
UNICODE_WORD = "([\\p{L}\\p{N}_]+)"
NUMBER = "(\\d+(?:[.,]\\d+)?)"
CITATION = "(?:\\[\\d+\\])+"


def join_title_text(title: Column, text: Column) -> Column:
    """Title and text, trimmed, blanks left out, with one space between."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(" ", filled(title), filled(text))


def script_tokens(text: Column) -> Column:
    """Lower-case runs of Hebrew or Latin letters or digits; vowel points and quotes are dropped first."""
    bare = F.regexp_replace(F.regexp_replace(text, VOWEL_POINTS, ""), QUOTES, "")
    return F.transform(F.regexp_extract_all(bare, F.lit(SCRIPT_RUN), F.lit(1)), F.lower)


def unicode_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit(UNICODE_WORD), F.lit(1))


def words(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(1))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def occurrences(text: Column, part: Column) -> Column:
    """How often a part occurs in a text, without overlaps."""
    return F.when(F.length(part) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long"))


def paragraphs(text: Column, separator: str = "\n") -> Column:
    """Trimmed parts of a text between separators, blanks left out."""
    # Not F.trim by itself, which would be given each part's index as the characters to trim.
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: p != "")


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def slug(text: Column) -> Column:
    """Slashes become underscores; other runs that are not letters or digits become one hyphen."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("/"), F.lit("_")), "[^a-z0-9_]+", "-"), F.lit("-"))


def size_number(text: Column) -> Column:
    """10K, 3M and 1B as numbers; other digits as they are; null if neither."""
    number = F.regexp_extract(text, "(?i)^([0-9]+)([kmb]?)$", 1)
    unit = F.lower(F.regexp_extract(text, "(?i)^([0-9]+)([kmb]?)$", 2))
    scale = F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).when(unit == "b", 1_000_000_000).otherwise(1)
    return F.when(number != "", number.cast("long") * scale)


def clip_words(text: Column, most: int) -> Column:
    return F.array_join(F.slice(words(text), 1, most), " ")


def length_ratio(translated: Column, source: Column) -> Column:
    """Code points of the translation for each of the source; 0 if the source is empty."""
    return F.when(F.length(source) > 0, F.length(translated) / F.length(source)).otherwise(0.0)


def last_space(text: Column, end: Column) -> Column:
    """1-based place of the last white space in the first ``end`` characters, 0 if none."""
    head = F.regexp_replace(F.substring(text, F.lit(1), end), "\\s", " ")
    back = F.instr(F.reverse(head), " ")
    return F.when(back == 0, 0).otherwise(F.length(head) - back + 1)


def first_space(text: Column, start: Column) -> Column:
    """1-based place of the first white space at or after a place, 0 if none."""
    tail = F.regexp_replace(F.substring(text, start, F.length(text)), "\\s", " ")
    at = F.instr(tail, " ")
    return F.when(at == 0, 0).otherwise(at + start - 1)
