"""Queries of readers, writers and the ladder: tables are written in a store's own shape and read back by the library."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import stubs
from quarry.operators import lexical
from quarry.plans import common as C
from quarry.plans.longdocs import WORDS
from quarry.plans.registry import query
from quarry.sources import readers as R
from quarry.sources import sinks as K
from quarry.streaming.ladder import Ladder
from quarry.streaming.phases import Phases, encoded_in_parts


def folder(spark: SparkSession) -> str:
    """A new folder beside the cluster's checkpoints; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-stores-")
    return f"{base.rstrip('/')}/stores-{uuid4().hex}"


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file of its own name, through the store's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(text.encode()))
    out.close()


def as_corpus(spark, sf) -> DataFrame:
    return C.docs(spark, sf).select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text")


def collection(spark, sf) -> str:
    """The tables as a collection: corpus, queries, and judgements in both shapes."""
    root = folder(spark)
    K.json_lines(as_corpus(spark, sf), f"{root}/corpus.jsonl")
    K.json_lines(C.questions(spark, sf).select(F.col("query_id").cast("string").alias("_id"), "text"), f"{root}/queries.jsonl")
    judged = C.table(spark, sf, "labels").select(F.concat(F.lit("q"), (F.col("doc_id") % 50).cast("string")).alias("query-id"), F.col("doc_id").cast("string").alias("corpus-id"), F.col("quality").cast("int").alias("score"))
    K.json_lines(judged.where("`corpus-id` % 2 = 0"), f"{root}/qrels/test.jsonl")
    rows = judged.where("`corpus-id` % 2 = 1").select(F.concat_ws("\t", "query-id", "corpus-id", F.col("score").cast("string")).alias("value"))
    odd = spark.createDataFrame([("query-id\tcorpus-id\tscore",), ("q1\tshort",), ("q1\td\tnone",)], "value string")
    rows.unionByName(odd).write.text(f"{root}/qrels/train.tsv")
    return root


JUDGED = "SELECT 'q' || (doc_id % 50) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS INT) AS score FROM labels"


@query("s01_corpus", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(concat_ws(' ', nullif(trim(source), ''), nullif(trim(text), ''))) AS text_md5 FROM documents")
def s01(spark, sf):
    return R.corpus(spark, collection(spark, sf)).select("doc_id", F.md5("text").alias("text_md5"))


@query("s02_corpus_raw", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(trim(text)) AS text_md5 FROM documents")
def s02(spark, sf):
    return R.corpus_raw(spark, collection(spark, sf)).select("doc_id", F.md5("text").alias("text_md5"))


@query("s03_queries", "SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark")
def s03(spark, sf):
    return R.queries(spark, collection(spark, sf))


@query("s04_qrels_of_lines", JUDGED + " WHERE doc_id % 2 = 0 AND quality > 0")
def s04(spark, sf):
    return R.qrels(spark, collection(spark, sf))


@query("s04_qrels_of_a_table", JUDGED + " WHERE doc_id % 2 = 1 AND quality > 0")
def s04t(spark, sf):
    return R.qrels(spark, collection(spark, sf), "train")


@query("s05_first_split", JUDGED + " WHERE doc_id % 2 = 0")
def s05(spark, sf):
    return R.qrels_any(spark, collection(spark, sf), ("dev", "test"))


@query("s06_training_judgements", JUDGED + " WHERE doc_id % 2 = 1")
def s06(spark, sf):
    return R.qrels(spark, collection(spark, sf), "train", positive=False)


@query("f05_positive_in_any_split", "SELECT DISTINCT query_id, doc_id FROM (" + JUDGED + " WHERE quality > 0)")
def f05(spark, sf):
    return R.positives(spark, collection(spark, sf))


@query("s07_latest_corpora", "SELECT 'even' AS dataset, count(*) AS n FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'odd', count(*) FROM documents WHERE doc_id % 2 = 1")
def s07(spark, sf):
    root, d = folder(spark), as_corpus(spark, sf)
    for run, rows in (("a", d), ("b", d.where("_id % 2 = 0"))):
        K.json_lines(rows, f"{root}/runs/{run}/corpus/even/beir/corpus.jsonl")
    K.json_lines(d.where("_id % 2 = 1"), f"{root}/runs/a/corpus/odd/beir/corpus.jsonl")
    found = R.latest_corpora(spark, root, ["even", "odd"])
    parts = [R.corpus(spark, path).agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), "n") for name, path in sorted(found.items())]
    return parts[0].unionByName(parts[1])


def as_lines(spark, sf) -> str:
    """Documents as lines of JSON with keys of either case, and lines that are broken."""
    path = folder(spark)
    d = C.docs(spark, sf)
    good = d.select(F.to_json(F.struct(F.col("doc_id").alias("ID"), F.col("text").alias("Text"), F.col("lang").alias("Lang"))).alias("value"))
    good.unionByName(d.where("doc_id % 50 = 0").select(F.lit("{broken").alias("value"))).write.text(path)
    return path


@query("s08_json_lines", "SELECT doc_id AS id, lang, md5(text) AS text_md5 FROM documents")
def s08(spark, sf):
    return R.json_lines(spark, [as_lines(spark, sf)]).select("id", "lang", F.md5("text").alias("text_md5"))


@query("s09_source_with_filters", "SELECT doc_id AS id, md5(text) AS text_md5 FROM documents WHERE lang = 'en'")
def s09(spark, sf):
    """One source of a configuration, by the registry, with a filter; ids are its records' keys."""
    source = {"name": "docs", "type": "jsonl", "files": [as_lines(spark, sf)], "options": {"guid_field": "id"}, "filter_criteria": [{"lang": "en"}]}
    return R.build(spark, {"sources": [source]}).select("id", F.md5("text").alias("text_md5"))


@query("s33_configured_sources", "SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'english' ELSE 'all' END AS name FROM documents")
def s33(spark, sf):
    """Two sources over shared defaults; a record that both have is the first one's."""
    path = as_lines(spark, sf)
    config = {"defaults": {"type": "jsonl", "files": [path], "options": {"guid_field": "id"}}, "sources": [{"name": "english", "filter_criteria": [{"lang": "en"}]}, {"name": "all"}]}
    return R.build(spark, config).select("id", F.col("_name").alias("name"))


def as_tree(spark, sf) -> str:
    root, d = folder(spark), C.docs(spark, sf)
    for name, rows in (("keep/a", "doc_id % 3 = 0"), ("keep/Skip", "doc_id % 3 = 1"), ("other", "doc_id % 3 = 2")):
        d.where(rows).select("doc_id", "text").write.option("compression", "gzip").json(f"{root}/{name}")
    return root


@query("s10_json_tree", "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id % 3 = 0")
def s10(spark, sf):
    return R.json_tree(spark, as_tree(spark, sf), ["keep/"], ["/skip"], "doc_id long, text string").select("doc_id", F.md5("text").alias("text_md5"))


@query("s11_tokens_of_a_tree", "SELECT CAST(sum(" + WORDS.format("text") + ") AS BIGINT) AS n_tokens FROM documents")
def s11(spark, sf):
    from quarry.functions.text import word_count

    return R.json_tree(spark, as_tree(spark, sf), schema="doc_id long, text string").agg(F.sum(word_count(F.col("text"))).alias("n_tokens"))


@query("s12_parquet_corpus", "SELECT CAST(doc_id AS VARCHAR) AS _id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS title, md5(text) AS text_md5 FROM documents")
def s12(spark, sf):
    paths, d = [f"{folder(spark)}/{i}" for i in (0, 1)], C.docs(spark, sf)
    for i, path in enumerate(paths):
        d.where(F.col("doc_id") % 2 == i).select(F.col("doc_id").alias("_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"), "text").write.parquet(path)
    return R.parquet_corpus(spark, paths).select("_id", "title", F.md5("text").alias("text_md5"))


@query("s13_subsets", "SELECT source || '_' || (doc_id // 2) AS _id, source AS subset FROM documents WHERE source IN ('src0', 'src1')")
def s13(spark, sf):
    d = C.docs(spark, sf)
    return R.subsets({s: d.where(F.col("source") == s).select(F.floor(F.col("doc_id") / 2).alias("_id")) for s in ("src0", "src1")})


@query("s14_fallback", "SELECT count(*) AS n FROM documents")
def s14(spark, sf):
    return R.first_that_reads(lambda: spark.read.parquet(f"{sf}/none.parquet"), lambda: C.docs(spark, sf)).agg(F.count("*").alias("n"))


@query("s15_positive_passages", "SELECT 'q' || (doc_id % 50) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(1 AS INT) AS score FROM labels WHERE quality > 0")
def s15(spark, sf):
    path = folder(spark)
    j = C.table(spark, sf, "labels").where("quality > 0")
    rows = j.groupBy(F.concat(F.lit("q"), (F.col("doc_id") % 50).cast("string")).alias("query_id")).agg(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("docid"), F.lit("t").alias("title"), F.lit("x").alias("text"))).alias("positive_passages"))
    K.json_lines(rows, path)
    return R.positive_passages(spark, path)


@query("s16_qa_pairs", "SELECT 't' || (item_id % 7) AS title, CAST(item_id AS VARCHAR) AS question_id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'a' || item_id END AS answer FROM benchmark")
def s16(spark, sf):
    path, b = folder(spark), C.table(spark, sf, "benchmark")
    answers = F.when(F.col("item_id") % 2 == 0, F.array(F.struct(F.concat(F.lit("a"), "item_id").alias("text")), F.struct(F.lit("other").alias("text")))).otherwise(F.array().cast("array<struct<text: string>>"))
    paragraph = F.struct(F.col("text").alias("context"), F.array(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), answers.alias("answers"))).alias("qas"))
    files = b.groupBy(F.concat(F.lit("t"), (F.col("item_id") % 7).cast("string")).alias("title")).agg(F.collect_list(paragraph).alias("paragraphs")).select(F.array(F.struct("title", "paragraphs")).alias("data"))
    files.write.option("maxRecordsPerFile", 1).json(path)
    return R.qa_pairs(spark, path).select("title", "question_id", "question", "answer")


@query("s18_successful_records", "SELECT doc_id AS id, md5(text) AS text_md5 FROM documents WHERE doc_id % 4 <> 0")
def s18(spark, sf):
    path = folder(spark)
    rows = C.docs(spark, sf).select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 4 != 0).alias("success"))
    K.json_lines(rows, path)
    return R.successes(spark, path, "id long, text string, success boolean").select("id", F.md5("text").alias("text_md5"))


FLAT = "regexp_replace(text, '\\s+', ' ', 'g')"


def as_csv(spark, sf) -> str:
    path = folder(spark)
    C.docs(spark, sf).select("doc_id", "text", "lang").write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


@query("s20_csv", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5({FLAT}) AS text_md5, lang FROM documents")
def s20(spark, sf):
    return R.csv(spark, as_csv(spark, sf)).select("doc_id", F.md5(F.regexp_replace("text", "\\s+", " ")).alias("text_md5"), "lang")


@query("s21_csv_header", "SELECT unnest(['doc_id', 'text', 'lang']) AS name, unnest([0, 1, 2]) AS place")
def s21(spark, sf):
    return spark.createDataFrame([(n, i) for i, n in enumerate(R.header(spark, as_csv(spark, sf)))], "name string, place int")


@query("s22_csv_columns", "SELECT lang, CAST(doc_id AS VARCHAR) AS doc_id FROM documents")
def s22(spark, sf):
    return R.csv(spark, as_csv(spark, sf), ["lang", "doc_id"])


@query("s23_first_shards", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey FROM supplier s ORDER BY s.s_suppkey % 3, s.s_suppkey LIMIT 15")
def s23(spark, sf):
    """The first 15 rows over numbered shards; a limit is what this reader is for."""
    root, t = folder(spark), C.table(spark, sf, "supplier").select("s_suppkey")
    for i in range(3):
        t.where(F.col("s_suppkey") % 3 == i).coalesce(1).sortWithinPartitions("s_suppkey").write.option("header", True).csv(f"{root}/{i}.csv")
    return R.first_shards(spark, root, 15)


@query("s24_results_tree", "SELECT 'ds' || n_regionkey AS dataset_slug, 'org/model-' || n_regionkey AS translation_model, 'p1' AS prompt_slug, 'judge' AS judge_model, 'queries' AS text_type, n_name AS _id, CAST(n_nationkey AS VARCHAR) AS score FROM nation")
def s24(spark, sf):
    root = folder(spark)
    tables: dict[int, list[str]] = {}
    for r in C.table(spark, sf, "nation").orderBy("n_nationkey").collect():  # a table of 25 rows
        tables.setdefault(r.n_regionkey, ["_id,score"]).append(f'"{r.n_name}",{r.n_nationkey}')
    for k, rows in tables.items():
        put(spark, f"{root}/evaluations/ds{k}/org/model-{k}/p1/judge/queries.csv", "\n".join(rows))
    return R.results_tree(spark, root).select("dataset_slug", "translation_model", "prompt_slug", "judge_model", "text_type", "_id", "score")


@query("s25_results_of_runs", "SELECT 'ds' || n_regionkey AS dataset, count(*) AS n FROM nation GROUP BY n_regionkey")
def s25(spark, sf):
    root = folder(spark)
    counts = C.table(spark, sf, "nation").groupBy("n_regionkey").count().collect()  # five rows
    for r in counts:
        put(spark, f"{root}/ds{r.n_regionkey}/results.json", '{\n "n": ' + str(r["count"]) + "\n}")
    return R.results_json(spark, root, "n long").select("dataset", "n")


@query("s26_predictions", "SELECT 'k' || doc_id AS key, md5('t ' || text) AS translation_md5, doc_id % 1000 AS prompt_tokens FROM documents")
def s26(spark, sf):
    path, d = folder(spark), C.docs(spark, sf)
    part = F.struct(F.concat(F.lit("t "), "text").alias("text"))
    response = F.struct(F.array(F.struct(F.struct(F.array(part).alias("parts")).alias("content"))).alias("candidates"), F.struct((F.col("doc_id") % 1000).alias("promptTokenCount")).alias("usageMetadata"))
    good = d.select(F.to_json(F.struct(F.concat(F.lit("k"), "doc_id").alias("key"), response.alias("response"))).alias("value"))
    good.unionByName(d.where("doc_id % 50 = 0").select(F.lit("{broken").alias("value"))).write.text(path)
    out = R.predictions(spark, [path])
    return out.select("key", F.md5("translation").alias("translation_md5"), F.col("prompt_tokens").cast("long").alias("prompt_tokens"))


def as_welded(spark, sf) -> str:
    path, d = folder(spark), C.docs(spark, sf)
    rows = d.select(F.lit("d").alias("dataset"), F.lit("random").alias("condition"), F.explode(F.array(F.lit(0), F.lit(3700))).alias("rung_chars"), (F.col("doc_id") % 5 == 0).alias("is_gold"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    bins = F.when(F.col("is_gold"), F.array(*map(F.lit, ("start", "middle", "end")))).otherwise(F.array(F.lit("start")))
    K.welded(rows.withColumn("position_bin", F.explode(bins)), path)
    return path


@query("s27_welded_corpus", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 5 = 0 AS is_gold, md5(text) AS text_md5 FROM documents")
def s27(spark, sf):
    return R.welded_corpus(spark, as_welded(spark, sf), "d", "random", 3700, "end").select("doc_id", "is_gold", F.md5("text").alias("text_md5"))


@query("s28_unpadded_corpus", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5 FROM documents")
def s28(spark, sf):
    return R.welded_corpus(spark, as_welded(spark, sf), "d", "random", 0, "start").select("doc_id", F.md5("text").alias("text_md5"))


@query("s29_neutral_filler", "SELECT 'ext' || doc_id AS pid, md5(text) AS text_md5 FROM documents WHERE length(text) BETWEEN 200 AND 3000 ORDER BY doc_id LIMIT 60000")
def s29(spark, sf):
    rows = R.neutral_filler(C.docs(spark, sf).select(F.col("doc_id").alias("position"), "text"))
    return rows.select("pid", F.md5("text").alias("text_md5"))


@query("s30_capped_by_dataset", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7")
def s30(spark, sf):
    """At most seven of each source: the cap is the feature."""
    return R.capped(C.docs(spark, sf).select("source", "doc_id"), "source", 7, ["doc_id"])


@query("s31_prefixed", "SELECT item_id, '[t] query: ' || text AS query, 'passage: ' || text AS positive, CASE WHEN item_id % 2 = 0 THEN 'passage: n' ELSE '' END AS hard_neg_0 FROM benchmark")
def s31(spark, sf):
    b = C.table(spark, sf, "benchmark")
    return R.prefixed(b.select("item_id", F.col("text").alias("query"), F.col("text").alias("positive"), F.when(F.col("item_id") % 2 == 0, "n").otherwise("").alias("hard_neg_0")), task="t")


@query("k01_records", "SELECT md5(text) AS text_md5, source AS _source, CAST(doc_id AS INT) AS _row_number FROM documents")
def k01(spark, sf):
    path = folder(spark)
    K.records(C.docs(spark, sf).select("text", F.col("source").alias("_source"), F.col("doc_id").alias("_row_number")), path, 500)
    return spark.read.parquet(path).select(F.md5("text").alias("text_md5"), "_source", "_row_number")


@query("k02_lines", "SELECT md5(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS line_md5, count(*) AS n FROM documents GROUP BY 1")
def k02(spark, sf):
    path = folder(spark)
    K.lines(C.docs(spark, sf), path)
    return spark.read.text(path).groupBy(F.md5("value").alias("line_md5")).agg(F.count("*").alias("n"))


@query("k03_json_lines", "SELECT doc_id, md5(text) AS text_md5, CAST(NULL AS VARCHAR) AS nothing FROM documents")
def k03(spark, sf):
    path = folder(spark)
    K.json_lines(C.docs(spark, sf).select("doc_id", "text", F.lit(None).cast("string").alias("nothing")), path)
    return spark.read.schema("doc_id long, text string, nothing string").json(path).select("doc_id", F.md5("text").alias("text_md5"), "nothing")


@query("k04_sharded", "SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) // 300 AS BIGINT) AS shard, CAST(doc_id AS VARCHAR) AS doc_id FROM documents")
def k04(spark, sf):
    """Written twice: the second time leaves no shard of the first."""
    path = folder(spark)
    for size in (100, 300):
        K.sharded(C.docs(spark, sf).select("doc_id", "lang"), path, size, ["doc_id"], "documents")
    return R.csv(spark, f"{path}/documents").select(F.col("shard").cast("long").alias("shard"), "doc_id")


@query("k05_appended", "SELECT source, 2 * count(*) AS n FROM documents GROUP BY source")
def k05(spark, sf):
    path = folder(spark)
    for _ in range(2):
        K.append(C.docs(spark, sf).select("doc_id", "source"), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


@query("k07_export", "SELECT CAST(doc_id AS VARCHAR) AS _id, upper(source) AS title, 'a' || doc_id || ' b' || doc_id AS text FROM documents")
def k07(spark, sf):
    path, d = folder(spark), C.docs(spark, sf)
    segments = d.select(F.col("doc_id").cast("string").alias("_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("segment_id"), F.col("source").alias("title"), F.upper("source").alias("title_translation"), "text", "doc_id")
    made = F.when(F.col("segment_id") == 0, F.concat(F.lit("a"), "doc_id")).when(F.col("segment_id") == 1, F.concat(F.lit("b"), "doc_id")).otherwise(" ")
    q = C.questions(spark, sf)
    K.export(segments.withColumn("translation", made).drop("doc_id"), q, q, path)
    return spark.read.schema("_id string, title string, text string").json(f"{path}/corpus")


@query("k09_review", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, substr(p_name, 1, 5) AS p_name FROM part")
def k09(spark, sf):
    path = folder(spark)
    K.review(C.table(spark, sf, "part").select("p_partkey", "p_name"), path, 5)
    return R.csv(spark, path)


@query("k11_index_kept", "WITH " + C.POSTINGS_SQL.format(min_df=2) + ",\n" + C.SCORED_SQL.format(k=10) + "\nSELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked")
def k11(spark, sf):
    """The index written once, and searched as it was read."""
    path = folder(spark)
    K.index(lexical.postings(C.docs(spark, sf).select("doc_id", "text")), path)
    ranked = lexical.top_k(lexical.scores(spark.read.parquet(path), C.questions(spark, sf)), 10)
    return ranked.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("k12_manifest", "SELECT CAST(l_linenumber AS VARCHAR) AS rung, count(*) AS n FROM lineitem GROUP BY 1")
def k12(spark, sf):
    path = folder(spark)
    K.dataset_manifest(spark, C.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("rung_chars")), path, seed=1)
    return spark.read.schema("documents map<string, long>, seed int").json(path).select(F.explode("documents").alias("rung", "n"))


SHARD = "_id string, text string"


def as_shards(spark, sf, n: int = 4) -> str:
    path = folder(spark)
    for i in range(n):
        C.docs(spark, sf).where(F.col("doc_id") % n == i).select(F.col("doc_id").cast("string").alias("_id"), "text").coalesce(1).write.mode("append").parquet(path)
    return path


@query("i02_resumed_ladder", "SELECT CAST(doc_id AS VARCHAR) AS _id, md5('t ' || text) AS translation_md5 FROM documents")
def i02(spark, sf):
    """A ladder begun over two shards and resumed over all: no row is lost or counted twice."""
    out, source, d = folder(spark), folder(spark), C.docs(spark, sf).select(F.col("doc_id").cast("string").alias("_id"), "text")
    translate = lambda t: F.concat(F.lit("t "), t)
    for half in range(2):
        for i in range(2):
            d.where(F.col("_id") % 4 == 2 * half + i).coalesce(1).write.mode("append").parquet(source)
        ladder = Ladder(spark, source, SHARD, out, translate, stubs.judge)
        ladder.run(resume=half > 0)
    return ladder.accumulated().select("_id", F.md5("translation").alias("translation_md5"))


@query("i04_stopped_and_resumed", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents")
def i04(spark, sf):
    """A gate that the first shard does not pass stops the ladder; a run that resumes takes all later shards."""
    out, source = folder(spark), as_shards(spark, sf)
    Ladder(spark, source, SHARD, out, lambda t: F.lit(""), stubs.judge).run()
    again = Ladder(spark, source, SHARD, out, F.upper, stubs.judge)
    again.run(resume=True)
    return again.accumulated().agg(F.count("*").alias("n"), F.count_distinct("_id").alias("ids"))


@query("i07_encoded_in_parts", "SELECT item_id AS doc_id FROM benchmark")
def i07(spark, sf):
    """Parts that are there are not made again."""
    path, rows = folder(spark), C.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    encoded_in_parts(rows, path, stubs.encode, 4)
    return encoded_in_parts(rows, path, stubs.encode, 4).select("doc_id")


@query("i09_phases", "SELECT 'a' AS dataset, 'export' AS state UNION ALL SELECT 'b', 'export'")
def i09(spark, sf):
    """One dataset fails in a phase at first; the others go on, and a second run takes it from there."""
    log, done = f"{folder(spark)}/log", []

    def step(phase, fails):
        def run(dataset):
            if dataset in fails:
                raise ValueError(phase)
            done.append((dataset, phase))
            return True

        return run

    order = ("candidates", "pilot", "pilot_qa", "export")
    Phases(spark, log, {p: step(p, ("b",) if p == "pilot" else ()) for p in order}).run(["a", "b"])
    state = Phases(spark, log, {p: step(p, ()) for p in order}).run(["a", "b"])
    if len(done) != len(set(done)):
        raise ValueError("a phase ran twice")
    return spark.createDataFrame(sorted(state.items()), "dataset string, state string")
