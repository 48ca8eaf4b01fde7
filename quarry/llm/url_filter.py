"""URL filters: fixed rules on host and path, and a naive Bayes verdict on segmented names for the rest.

A host's names are segmented into words by a unigram Viterbi: the split whose words' log
probabilities add up to most, where a word unknown to the counts pays for its length. The counts are
those of all path tokens of the table (hosts would teach the very names that are to be split) and a
short list of common web words. A multinomial naive Bayes over the words of host and path, with
add-one smoothing and the classes' own shares, then gives the verdict. It learns from the URLs that a
rule decides and from the list of cue words; its counts cover all rows.

Counts, odds and segmented names are tables, whole, and never on the driver. Each distinct name of a
host meets the counts of its own substrings, of up to LONGEST letters, by a join, and is split with
those alone: no other count can change its best split. Each distinct host, and each distinct path
with its numbers as one word, is scored once, and pages join both.

Edge cases: a null url, or one without `://`, has an empty host and path, no rule, and the verdict of
the classes' shares (allow where they are even). Hosts keep their port and user part. Repeated rows
get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, cut

# The rules, each a verdict and a host with the beginning of a path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
# Common words of hosts, for segmentation, and cue words for either verdict.
WEB_WORDS = "www blog mail shop store news forum wiki docs help support media data cloud online world home book learn school health travel food music photo video game sport tech code open free best web site page link list spam farm casino poker bet loan cheap pill adult porn sex xxx crack warez torrent".split()
CUES = {
    "block": "spam farm casino poker bet loan cheap pill adult porn sex xxx crack warez torrent".split(),
    "allow": "blog news wiki docs help support school learn health travel book music code".split(),
}
#: Fixed value: the most letters that a name between two dots of a host can have.
LONGEST = 63
#: How often a word of the fixed list counts.
CUE_WEIGHT = 5


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    # (?s): also past line feeds
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*(/[^?#]*)?", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(RULES, key=lambda r: len(r[1])):
        name, start = rule.split("/", 1)
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _tokens(text: Column) -> Column:
    """Letter runs of host or path; a run of digits is the one token 0."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+|[0-9]+)"), F.lit(1))


class Segmenter:
    """Unigram Viterbi over letters."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = total or sum(counts.values()) or 1
        self.log = {w: math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(1 / (10 * total))

    def words(self, name: str) -> tuple[str, ...]:
        best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                # An unknown word costs as much as a rare one, and more for each letter.
                score = best[start] + self.log.get(word, self.unknown - 2.0 * len(word))
                if score > best[end]:
                    best[end], back[end] = score, start
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(out[::-1])


def unigrams(paths: DataFrame) -> DataFrame:
    """(word, n): counts of the letter tokens of all paths, and of the fixed list."""
    tokens = paths.select(F.explode(_tokens(F.col("path"))).alias("word"), "n").where("word rlike '^[a-z]'")
    counts = tokens.groupBy("word").agg(F.sum("n").alias("n"))
    lifted = paths.sparkSession.createDataFrame([(w,) for w in WEB_WORDS], "word string").crossJoin(counts.agg(F.greatest(F.lit(1), F.floor(F.coalesce(F.max("n"), F.lit(1)) / 4)).alias("n")))
    return cut(counts.unionByName(lifted).groupBy("word").agg(F.sum("n").alias("n")))


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct names(name), each with the counts of its own substrings."""
    size = F.length("name")
    spans = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - i + 1)), lambda n: F.substring("name", i, n)))
    parts = names.select("name", F.explode(F.array_distinct(F.flatten(spans))).alias("word"))
    known = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    total = counts.agg(F.sum("n").alias("total"))
    rows = names.join(known, "name", "left").crossJoin(F.broadcast(total))

    def make():
        def work(batch):
            name, known, total = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "known", "total"))
            return [[Segmenter({x["word"]: x["n"] for x in k or ()}, t).words(w) for w, k, t in zip(name, known, total)]]

        return work

    return annotate(rows, [("words", T.ArrayType(T.StringType()), pa.list_(pa.string()))], make).select("name", "words")


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words): segmented names of each distinct host but its last, numbers as one word, and the last as it is."""
    names = hosts.select("host", F.posexplode(_tokens(F.col("host"))).alias("at", "name"), F.size(_tokens(F.col("host"))).alias("of"))
    split = segmented(names.where("name rlike '^[a-z]'").select("name").distinct(), counts)
    last = F.when(F.col("at") == F.col("of") - 1, F.array(F.concat(F.lit("host:"), "name"))).otherwise(F.array().cast("array<string>"))
    inner = F.when((F.col("at") < F.col("of") - 1) | (F.col("of") == 1), F.coalesce("words", F.array(F.lit("0")))).otherwise(F.array().cast("array<string>"))
    listed = names.join(split, "name", "left").select("host", "at", F.concat(inner, last).alias("words"))
    gathered = listed.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    return cut(hosts.join(gathered, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words")))


def path_words(path: Column) -> Column:
    return F.transform(_tokens(path), lambda t: F.concat(F.lit("path:"), F.when(t.rlike("^[0-9]"), "0").otherwise(t)))


def learn(shapes: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Naive Bayes: (word, odds), log odds of block against allow, and (prior), one row, that of the classes' shares.

    shapes: (host, path, rule, n); hosts: (host, words).
    """
    verdicts = dict((rule, verdict) for verdict, rule in RULES)
    decided = shapes.where("rule is not null").withColumn("block", F.element_at(F.create_map(*(F.lit(x) for p in verdicts.items() for x in p)), F.col("rule")) == "block")
    by = lambda n: (F.coalesce(F.sum(F.when(F.col("block"), n)), F.lit(0)).alias("b"), F.coalesce(F.sum(F.when(~F.col("block"), n)), F.lit(0)).alias("a"))
    # Words of a host count once for all its pages, words of a path once for all pages of that shape.
    of_hosts = decided.groupBy("host", "block").agg(F.sum("n").alias("n")).join(hosts, "host").select("block", "n", F.explode("words").alias("word"))
    of_paths = decided.groupBy("path", "block").agg(F.sum("n").alias("n")).select("block", "n", F.explode(path_words(F.col("path"))).alias("word"))
    cues = [(v == "block", CUE_WEIGHT, w) for v, listed in CUES.items() for w in listed]
    fixed = shapes.sparkSession.createDataFrame(cues, "block boolean, n long, word string")
    counts = cut(of_hosts.unionByName(of_paths).unionByName(fixed).groupBy("word").agg(*by(F.col("n"))))
    total = counts.agg((F.sum("b") + F.count("*") + 1).alias("total_b"), (F.sum("a") + F.count("*") + 1).alias("total_a"))
    odds = counts.crossJoin(F.broadcast(total)).select("word", (F.log((F.col("b") + 1) / F.col("total_b")) - F.log((F.col("a") + 1) / F.col("total_a"))).alias("odds"))
    prior = decided.agg(*by(F.col("n"))).select((F.log(F.col("b") + 1.0) - F.log(F.col("a") + 1.0)).alias("prior"))
    return cut(odds), cut(prior)


def _sums(keyed: DataFrame, odds: DataFrame, key: str, name: str) -> DataFrame:
    """(key, sum of odds) of keyed(key, words), one row for each key; words without odds add nothing."""
    words = keyed.select(key, F.explode("words").alias("word"))
    found = words.join(odds, "word").groupBy(key).agg(F.sum("odds").alias(name))
    return keyed.select(key).join(found, key, "left").select(key, F.coalesce(name, F.lit(0.0)).alias(name))


def filter_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of block by the method) of each page."""
    verdicts = dict((rule, verdict) for verdict, rule in RULES)
    host, path = parts(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"), rule_of(host, path).alias("rule")).withColumn("__shape", F.regexp_replace(F.lower("path"), "[0-9]+", "0"))
    shapes = cut(placed.groupBy("host", F.col("__shape").alias("path"), "rule").agg(F.count("*").alias("n")))
    counts = unigrams(shapes.groupBy("path").agg(F.sum("n").alias("n")))
    hosts = host_words(shapes.select("host").distinct(), counts)
    odds, prior = learn(shapes, hosts)
    by_host = _sums(hosts, odds, "host", "__of_host")
    by_path = _sums(shapes.select(F.col("path").alias("__shape")).distinct().withColumn("words", path_words(F.col("__shape"))), odds, "__shape", "__of_path")
    score = F.round(F.col("prior") + F.col("__of_host") + F.col("__of_path"), 9)
    ruled = F.element_at(F.create_map(*(F.lit(x) for p in verdicts.items() for x in p)), F.col("rule"))
    rows = placed.join(by_host, "host").join(by_path, "__shape").crossJoin(F.broadcast(prior)).withColumn("score", score)
    return rows.select("page_id", "host", "path", "rule", F.coalesce(ruled, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
