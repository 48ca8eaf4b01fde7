"""Readers of text collections. All paths go through Spark, so any of its stores will do."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import guid
from quarry.functions.text import join_title_text

CORPUS = "_id string, title string, text string, title_en string, text_en string"
QUERIES = "_id string, text string, text_en string"
QRELS = "`query-id` string, `corpus-id` string, score int"
QA = "data array<struct<title: string, paragraphs: array<struct<context: string, qas: array<struct<id: string, question: string, answers: array<struct<text: string>>>>>>>>"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listing(spark: SparkSession, glob: str) -> list[tuple[str, int]]:
    """(path, modification time) of what a glob matches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return [(str(f.getPath()), f.getModificationTime()) for f in found or []]


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text): title and text joined."""
    rows = spark.read.schema(CORPUS).json(f"{folder}/corpus.jsonl")
    return rows.select(F.col("_id").alias("doc_id"), join_title_text(F.col("title"), F.col("text")).alias("text"))


def corpus_raw(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text): the text alone, trimmed; what can be equal to a query."""
    return spark.read.schema(CORPUS).json(f"{folder}/corpus.jsonl").select(F.col("_id").alias("doc_id"), F.trim("text").alias("text"))


def queries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(QUERIES).json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), "text")


def _qrels_tsv(spark: SparkSession, path: str, separator: str = "\\s+") -> DataFrame:
    """Rows of a judgement table in text; a head line, short lines and lines without a number go."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), separator).alias("p")).where(F.size("p") >= 3)
    score = F.try_element_at("p", F.lit(3)).try_cast("double").cast("int")
    return parts.select(F.col("p")[0].alias("query_id"), F.col("p")[1].alias("doc_id"), score.alias("score")).where("score is not null")


def qrels(spark: SparkSession, folder: str, split: str = "test", positive: bool = True) -> DataFrame:
    """(query_id, doc_id, score) of a split: JSON lines if they are there, else a table in text."""
    base = f"{folder}/qrels/{split}"
    if exists(spark, f"{base}.jsonl"):
        rows = spark.read.schema(QRELS).json(f"{base}.jsonl").select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), "score")
    else:
        rows = _qrels_tsv(spark, f"{base}.tsv")
    return rows.where("score > 0") if positive else rows


def qrels_any(spark: SparkSession, folder: str, splits: Iterable[str] = ("test", "dev", "validation")) -> DataFrame:
    """Judgements of the first split there is, those of 0 as well; an error if there is none."""
    for split in splits:
        for ending in ("jsonl", "tsv"):
            if exists(spark, f"{folder}/qrels/{split}.{ending}"):
                return qrels(spark, folder, split, positive=False)
    raise FileNotFoundError(f"no judgements in {folder}/qrels")


def positives(spark: SparkSession, folder: str, splits: Iterable[str] = ("train", "dev", "validation", "test")) -> DataFrame:
    """(query_id, doc_id) that are positive in any split there is."""
    found = [qrels(spark, folder, s) for s in splits if any(exists(spark, f"{folder}/qrels/{s}.{e}") for e in ("jsonl", "tsv"))]
    if not found:
        raise FileNotFoundError(f"no judgements in {folder}/qrels")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select("query_id", "doc_id").distinct()


def latest_corpora(spark: SparkSession, root: str, wanted: list[str] | None = None) -> dict[str, str]:
    """Folder of the latest corpus of each dataset under root/runs/*/corpus/*/beir."""
    best: dict[str, tuple[int, str]] = {}
    for path, at in listing(spark, f"{root}/runs/*/corpus/*/beir/corpus.jsonl"):
        folder = path.rsplit("/", 1)[0]
        name = folder.rsplit("/", 2)[1]
        best[name] = max(best.get(name, (0, "")), (at, folder))
    missing = [w for w in wanted or [] if w not in best]
    if missing:
        raise FileNotFoundError(f"no corpus of {', '.join(missing)} under {root}")
    return {name: folder for name, (_, folder) in best.items()}


def json_lines(spark: SparkSession, paths: list[str], text: str = "text", guid_field: str | None = None, exclude: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Records of many files, malformed lines left out, keys in lower case, with guid, text and where they stood.

    _row_number is a record's place in its file, from 0; a byte order mark before a file's first line
    is dropped.
    """
    at = {"_file": F.col("_metadata.file_name"), "__block": F.col("_metadata.file_block_start")}
    lines = spark.read.text(paths, recursiveFileLookup=True).withColumns(at)
    for name in exclude or []:
        lines = lines.where(~F.contains("_file", F.lit(name)))
    lines = lines.withColumn("value", F.ltrim(F.regexp_replace("value", "^\\uFEFF", ""))).withColumn("__order", F.monotonically_increasing_id())
    schema = spark.read.json(paths, recursiveFileLookup=True).schema
    fields = [f for f in schema.fields if f.name != "_corrupt_record"]
    parsed = F.from_json("value", "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields) + ", _corrupt_record: string>", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.withColumn("__r", parsed).where("__r is not null and __r._corrupt_record is null")
    nth = F.row_number().over(Window.partitionBy("_file").orderBy("__order")).cast("long") - 1
    names = {f.name.lower(): f.name for f in fields}
    own = [F.col("__r")[names[k]].alias(k) for k in names if k not in ("guid", "text")]
    body = F.col("__r")[names[text.lower()]].cast("string")
    given = F.col("__r")[names[guid_field.lower()]] if guid_field else F.lit(None)
    rows = rows.withColumn("_row_number", nth)
    if limit is not None:
        rows = rows.where(F.col("_row_number") < limit)
    return rows.select(*own, guid(given, body).alias("guid"), body.alias("text"), F.col("_file").alias("_source"), "_file", "_row_number")


def json_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """Records of a tree of (compressed) JSON lines with _path; parts of paths that must, or must not, be in it."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(root).withColumn("_path", F.col("_metadata.file_path"))
    if include:
        keep = F.lit(False)
        for part in include:
            keep = keep | F.contains("_path", F.lit(part))
        rows = rows.where(keep)
    for part in exclude or []:
        rows = rows.where(~F.contains(F.lower("_path"), F.lit(part.lower())))
    return rows


def parquet_corpus(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Corpus tables with ids as text and missing titles and texts blank."""
    rows = spark.read.parquet(*paths)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c)
    return rows.select(F.col("_id").cast("string").alias("_id"), text("title"), text("text"))


def subsets(parts: dict[str, DataFrame], key: str = "_id") -> DataFrame:
    """A union of subsets whose ids are made unique by their names."""
    out = None
    for name, rows in parts.items():
        named = rows.withColumn(key, F.concat_ws("_", F.lit(name), F.col(key).cast("string"))).withColumn("subset", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def first_that_reads(*readers: Callable[[], DataFrame]) -> DataFrame:
    """What the first reader gives whose source is there; the last one's error if none is."""
    for read in readers[:-1]:
        try:
            return read()
        except Exception as e:  # Spark says in the message that a path is missing
            if "PATH_NOT_FOUND" not in str(e) and not isinstance(e, FileNotFoundError):
                raise
    return readers[-1]()


def qa_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(title, paragraph, context, question_id, question, answer) of nested question files; the first answer or null."""
    rows = spark.read.schema(QA).json(path, multiLine=True).select(F.explode("data").alias("a"))
    rows = rows.select(F.col("a.title").alias("title"), F.posexplode("a.paragraphs").alias("paragraph", "p"))
    rows = rows.select("title", "paragraph", F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    return rows.select("title", "paragraph", "context", F.col("q.id").alias("question_id"), F.col("q.question").alias("question"), F.get(F.col("q.answers"), F.lit(0))["text"].alias("answer"))


def positive_passages(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, score): every positive passage that a query's record lists, graded 1."""
    rows = spark.read.schema("query_id string, positive_passages array<struct<docid: string, title: string, text: string>>").json(path)
    return rows.select("query_id", F.explode("positive_passages.docid").alias("doc_id"), F.lit(1).alias("score"))


def successes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of lists, converted to JSON lines once, that were made with success."""
    return spark.read.schema(schema).json(path).where("success").drop("success")


def results_json(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """What each folder's results.json says, with the folder's name as dataset."""
    rows = spark.read.schema(schema).json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter="results.json")
    return rows.withColumn("dataset", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/results\\.json$", 1))


def csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table with quoted line feeds; only the given columns, in order, as text."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select(*columns) if columns else rows


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a table, without reading its rows."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').columns


def first_shards(spark: SparkSession, root: str, rows: int) -> DataFrame:
    """The first rows of numbered shards, in order of shard and place; later shards are not opened."""
    paths = sorted(path for path, _ in listing(spark, f"{root}/*.csv"))
    out, left = None, rows
    for path in paths:
        part = csv(spark, path).limit(left)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        left -= part.count()
        if left <= 0:
            break
    if out is None:
        raise FileNotFoundError(f"no shards in {root}")
    return out


def results_tree(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all result tables under a root, with the factors that their paths tell.

    A path is .../evaluations/<dataset>/<translation model>/<prompt>/<judge>/<queries or documents>.csv;
    a model's name may have a slash itself.
    """
    rows = spark.read.csv(root, header=True, multiLine=True, escape='"', recursiveFileLookup=True).withColumn("_path", F.col("_metadata.file_path"))
    tail = F.regexp_extract("_path", "/(?:evaluations|eval_calibration)/(.*)$", 1)
    pattern = "^([^/]+)/(.+)/([^/]+)/([^/]+)/([^/.]+)\\.csv$"
    names = ("dataset_slug", "translation_model", "prompt_slug", "judge_model", "text_type")
    return rows.select("*", *(F.regexp_extract(tail, pattern, i + 1).alias(n) for i, n in enumerate(names))).where("dataset_slug <> ''")


def predictions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(key, translation, prompt_tokens) of shards of nested responses; malformed lines left out."""
    from quarry.functions.parsers import response_text, response_tokens

    lines = spark.read.text(paths)
    rows = lines.select(F.get_json_object("value", "$.key").alias("key"), F.get_json_object("value", "$.response").alias("response")).where("key is not null")
    return rows.select("key", response_text(F.col("response")).alias("translation"), response_tokens(F.col("response")).alias("prompt_tokens"))


def neutral_filler(rows: DataFrame, least: int = 200, most: int = 3000, n: int = 60_000) -> DataFrame:
    """(pid, text): the first n texts of a fit length, in order of their column position."""
    kept = rows.where(F.length("text").between(least, most)).orderBy("position").limit(n)
    return kept.select(F.concat(F.lit("ext"), F.col("position").cast("string")).alias("pid"), "text")


def welded_corpus(spark: SparkSession, root: str, dataset: str, condition: str, rung: int, position: str) -> DataFrame:
    """The documents of one setting: all that are no golds, and the golds at one position; an error on repeated ids."""
    rows = spark.read.parquet(root).where((F.col("dataset") == dataset) & (F.col("condition") == condition) & (F.col("rung_chars") == rung))
    # A flag that is part of a path comes back as text.
    rows = rows.withColumn("is_gold", F.col("is_gold").cast("boolean")).where(~F.col("is_gold") | (F.col("position_bin") == position))
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        raise ValueError("an id occurs twice")
    return rows


def capped(rows: DataFrame, by: str, n: int, order: list) -> DataFrame:
    """At most n rows of each dataset, the first in order."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth")


def prefixed(rows: DataFrame, query: str = "query: ", passage: str = "passage: ", task: str | None = None) -> DataFrame:
    """query and passages with what models expect before them."""
    head = f"[{task}] {query}" if task else query
    out = rows.withColumn("query", F.concat(F.lit(head), F.col("query")))
    for c in rows.columns:
        if c == "positive" or c.startswith("hard_neg_"):
            out = out.withColumn(c, F.when(F.col(c) != "", F.concat(F.lit(passage), F.col(c))).otherwise(F.col(c)))
    return out


#: Readers by the kind of source that a configuration names.
REGISTRY: dict[str, Callable[..., DataFrame]] = {"jsonl": json_lines, "json_tree": json_tree, "csv": csv, "qa": qa_pairs, "parquet": lambda spark, paths: spark.read.parquet(*paths)}


#: Builders in the order they were registered: what recognises a configuration, and what reads it.
BUILDERS: list[tuple[Callable[[dict], bool], Callable[[SparkSession, dict], DataFrame]]] = []


def builder(is_match: Callable[[dict], bool]) -> Callable:
    """Register a reader for the configurations that it recognises."""

    def add(function: Callable[[SparkSession, dict], DataFrame]) -> Callable[[SparkSession, dict], DataFrame]:
        BUILDERS.append((is_match, function))
        return function

    return add


@builder(lambda config: "sources" in config)
def _sources(spark: SparkSession, config: dict) -> DataFrame:
    return build(spark, config)


@builder(lambda config: str(config.get("folder", "")) != "")
def _collection(spark: SparkSession, config: dict) -> DataFrame:
    return corpus(spark, config["folder"])


def discovered(spark: SparkSession, config: dict) -> DataFrame:
    """What the first builder that recognises a configuration reads; an error if none does."""
    for is_match, function in BUILDERS:
        if is_match(config):
            return function(spark, config)
    raise KeyError(f"no builder recognises {sorted(config)}")


def merged(base: dict, more: dict) -> dict:
    """A configuration over its defaults, nested ones merged."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in more.items()}


def build(spark: SparkSession, config: dict) -> DataFrame:
    """The union of a configuration's sources, each with its name, options and filters, first of each guid kept."""
    from quarry.operators.corpus import first_of, matching

    out = None
    for i, given in enumerate(config["sources"]):
        source = merged(config.get("defaults", {}), given)
        if source["type"] not in REGISTRY:
            raise KeyError(f"no reader for a source of type {source['type']}")
        rows = REGISTRY[source["type"]](spark, source["files"], **source.get("options", {}))
        if source.get("filter_criteria"):
            rows = matching(rows, source["filter_criteria"])
        rows = rows.withColumn("_name", F.lit(source["name"])).withColumn("_source_no", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return first_of(out, ["guid"], ["_source_no", "_file", "_row_number"]).drop("_source_no")
