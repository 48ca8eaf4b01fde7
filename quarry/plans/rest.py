"""Queries of what runs beside the tables: the batch variant, guards, logs, caches, routes and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import parsers as P
from quarry.functions import stubs
from quarry.operators import analysis, longctx, verify
from quarry.operators import enrichment as E
from quarry.plans import common as C
from quarry.plans.registry import query
from quarry.plans.stores import SHARD, as_lines, as_shards, collection, folder, put
from quarry.sources import readers as R
from quarry.sources import sinks as K
from quarry.streaming.batch import Batch
from quarry.streaming.ladder import Killed, Ladder
from quarry.streaming.phases import cache_key


@query("s17_marked_articles", "SELECT doc_id, lang AS title, source AS section, md5(coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)), '')) AS body_md5 FROM documents")
def s17(spark, sf):
    """Marked articles as a store holds them, parted into title, section and paragraphs."""
    path = folder(spark)
    body = F.replace("text", F.lit("\n"), F.lit(P.NEWLINE))
    marked = F.concat(F.lit(f"\n{P.ARTICLE}\n"), "lang", F.lit(f"\n{P.SECTION}\n"), "source", F.lit(f"\n{P.PARAGRAPH}\n"), body)
    K.json_lines(C.docs(spark, sf).select("doc_id", marked.alias("text")), path)
    rows = spark.read.schema("doc_id long, text string").json(path).select("doc_id", P.article(F.col("text")).alias("a"))
    first = F.get("a.sections", F.lit(0))
    return rows.select("doc_id", "a.title", first["title"].alias("section"), F.md5(F.array_join(first["paragraphs"], "\n")).alias("body_md5"))


@query("s19_pages_of_a_store", "SELECT doc_id, lang AS title, source AS heading, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')) AS body_md5 FROM documents")
def s19(spark, sf):
    """Pages with a heading, navigation, a table and a paragraph: only the paragraph is the section's body."""
    path = folder(spark)
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    around = ("<html><head><title>", "</title></head><body><nav>menu</nav><main><h2>", "</h2><table><tr><td>1</td></tr></table><p>", "</p></main></body></html>")
    html = F.concat(F.lit(around[0]), "lang", F.lit(around[1]), "source", F.lit(around[2]), escaped, F.lit(around[3]))
    C.docs(spark, sf).select("doc_id", html.alias("html")).write.parquet(path)
    rows = spark.read.parquet(path).select("doc_id", P.page(F.col("html")).alias("p"))
    first = F.get("p.sections", F.lit(0))
    body = F.trim(F.regexp_replace(F.replace(first["body"], F.lit("[table]"), F.lit("")), "\\s+", " "))
    return rows.select("doc_id", "p.title", first["heading"].alias("heading"), F.md5(body).alias("body_md5"))


@query("s32_discovered_builders", "SELECT 'collection' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'sources', count(*) FROM documents")
def s32(spark, sf):
    """Two configurations, each read by the builder that recognises it."""
    listed = {"sources": [{"name": "docs", "type": "jsonl", "files": [as_lines(spark, sf)], "options": {"guid_field": "id"}}]}
    given = {"collection": {"folder": collection(spark, sf)}, "sources": listed}
    counted = [R.discovered(spark, config).agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, config in given.items()]
    return counted[0].unionByName(counted[1])


@query("k06_history_log", "SELECT o_orderstatus, 2 * count(*) AS entries, max(o_orderkey) AS last FROM orders GROUP BY o_orderstatus")
def k06(spark, sf):
    """A log only grows: a second run's entries stand beside the first one's."""
    path, rows = folder(spark), C.table(spark, sf, "orders").select("o_orderstatus", "o_orderkey")
    K.append(rows, path)
    K.append(rows, path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("entries"), F.max("o_orderkey").alias("last"))


@query("k10_markdown_table", "WITH t AS (SELECT r_name AS region, count(*) AS n, avg(n_nationkey) AS mean FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) SELECT '| region | n | mean |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || region || ' | ' || n || ' | ' || printf('%.3f', mean) || ' |', chr(10) ORDER BY region) AS shown FROM t")
def k10(spark, sf):
    """A small table, rendered on the driver."""
    rows = C.table(spark, sf, "nation").join(C.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"), F.avg("n_nationkey").alias("mean"))
    return spark.createDataFrame([(analysis.markdown(rows.orderBy("region")),)], "shown string")


@query("w13_dealt_to_sides", "WITH p AS (SELECT source, doc_id, length(text) + 2 AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents), k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source, place % 2 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT source, place, place % 2 AS side, doc_id AS pid FROM k WHERE before < 27000")
def w13(spark, sf):
    """Passages of each source, dealt to two tapes in turn until both have enough."""
    d = C.docs(spark, sf).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("nth"), F.col("doc_id").alias("pid"), F.length("text").cast("long").alias("n_chars"))
    return longctx.dealt(d, 27000).select(F.col("doc_id").alias("source"), "place", "side", "pid")


@query("l07_pool_in_order", "SELECT CAST(doc_id AS VARCHAR) AS pid, length(text) AS n_chars, CAST(1 AS BIGINT) AS ordered FROM documents")
def l07(spark, sf):
    """A pool as it was written: in every file, each pid is above the one before."""
    path = folder(spark)
    K.pool(C.docs(spark, sf).select(F.col("doc_id").cast("string").alias("pid"), "text"), path)
    rows = spark.read.schema("pid string, text string").json(path).select("pid", F.length("text").alias("n_chars"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("pid").over(Window.partitionBy("file").orderBy("at"))
    return rows.select("pid", "n_chars", F.when(before.isNull() | (before < F.col("pid")), 1).otherwise(0).cast("long").alias("ordered"))


@query("p09_snapped_tails", """WITH c AS (SELECT doc_id, text, CASE WHEN length(text) <= 500 THEN -1 ELSE list_min(list_filter(generate_series(length(text) - 500, length(text) - 468), lambda i: regexp_matches(substr(text, i, 1), '^\\s$'))) END AS space FROM documents)
SELECT doc_id, md5(CASE WHEN space = -1 THEN text WHEN space IS NULL THEN substr(text, length(text) - 499) ELSE substr(text, space + 1) END) AS tail_md5 FROM c""")
def p09(spark, sf):
    return C.docs(spark, sf).select("doc_id", F.md5(longctx.tail(F.col("text"), F.lit(500))).alias("tail_md5"))


@query("r14_refused_windows", "SELECT w AS size, w > 8192 AS refused FROM (SELECT unnest([512, 8192, 8193, 32768]) AS w)")
def r14(spark, sf):
    """Windows beyond what a model was made for are refused."""

    def refused(size: int) -> bool:
        try:
            longctx.check_window(size, 8192)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(n, refused(n)) for n in (512, 8192, 8193, 32768)], "size int, refused boolean")


@query("v19_missing_columns", "SELECT w AS name FROM (SELECT unnest(['doc_id', 'judge', 'score', 'text']) AS w) WHERE w NOT IN (SELECT column_name FROM (DESCRIBE documents))")
def v19(spark, sf):
    missing = verify.columns_present(C.docs(spark, sf), ["doc_id", "judge", "score", "text"])
    return spark.createDataFrame([(c,) for c in missing], "name string")


@query("i05_kill_guard", "SELECT count(*) AS n, true AS refused FROM documents")
def i05(spark, sf):
    """A ladder that ran is not started again without the wish to resume it, and loses nothing by the attempt."""
    out, source = folder(spark), as_shards(spark, sf, 2)
    Ladder(spark, source, SHARD, out, F.upper, stubs.judge).run()
    again = Ladder(spark, source, SHARD, out, F.upper, stubs.judge)
    refused = False
    try:
        again.run()
    except Killed:
        refused = True
    return again.accumulated().agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


def batch_rows(spark, sf) -> DataFrame:
    """Documents as rows of enrichment: every third one is done, and each source is a dataset."""
    done = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("old "), "text"))
    return C.docs(spark, sf).select(F.col("source").alias("dataset"), F.col("doc_id").alias("_id"), F.concat(F.lit(" "), "lang").alias("title"), "text", done.alias("translation"))


@query("i10_batch_variant", "SELECT doc_id AS _id, source AS dataset, md5(CASE WHEN doc_id % 3 = 0 THEN 'old ' || text ELSE replace(upper(replace('#' || source || ' ' || text, 'ß', 'SS')), 'ẞ', 'SS') END) AS translation_md5, upper(lang) AS title FROM documents WHERE source <> 'src1'")
def i10(spark, sf):
    """Pilot, submission and collection: a dataset whose pilot failed is neither asked for nor exported."""
    rows = batch_rows(spark, sf)
    # The stand-in fails on one dataset: its texts, marked, come back blank.
    mark = F.when(F.col("dataset") == "src1", "#bad").otherwise(F.concat(F.lit("#"), "dataset"))
    batch = Batch(spark, rows.withColumn("text", F.concat_ws(" ", mark, "text")), folder(spark), stubs.judge)
    batch.pilot(lambda t: F.when(t.startswith("#bad"), "").otherwise(stubs.translate(t)), 5)
    batch.submit()
    batch.collect(batch.requests().select("key", stubs.translate(F.col("text")).alias("translation")), F.upper)
    return batch.exported().select("_id", "dataset", F.md5("translation").alias("translation_md5"), F.col("title_translation").alias("title"))


@query("x03_lines_to_table", "SELECT md5(text) AS key, min(CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'moved' END) AS value FROM documents GROUP BY md5(text)")
def x03(spark, sf):
    """A cache of lines moved to a table: keys that the table has stay as they are, malformed lines go."""
    path, d = folder(spark), C.docs(spark, sf).select(F.md5("text").alias("key"), "doc_id")
    d.where("doc_id % 2 = 1").select("key", F.lit("moved").alias("translation"), "doc_id").write.json(path)
    put(spark, f"{path}/part-99999.json", '{"key": "cut off\n')
    lines = spark.read.schema("key string, translation string, doc_id long").option("mode", "DROPMALFORMED").json(path)
    table = d.where("doc_id % 2 = 0").select("key").distinct().withColumn("translation", F.lit("kept"))
    return table.unionByName(E.to_insert(lines, table, "doc_id")).select("key", F.col("translation").alias("value"))


@query("x04_cache_names", "SELECT arm || '-chunked-w' || w || '-s' || (w // 4) || '-t7' AS name FROM (SELECT unnest(['base', 'tuned']) AS arm), (SELECT unnest([512, 2048]) AS w)")
def x04(spark, sf):
    """Vectors of another arm, window or stride have another cache."""
    return spark.createDataFrame([(cache_key(arm, "chunked", w, w // 4, 7),) for arm in ("base", "tuned") for w in (512, 2048)], "name string")


@query("e03_routes", "SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'google' WHEN 3 THEN 'together' WHEN 4 THEN 'openrouter' END AS service FROM nation")
def e03(spark, sf):
    """Services by the names of models; no service answers for the last kind."""
    names = F.array(*map(F.lit, ("GPT-", "claude-", "gemini-", "Qwen/", "maker/", "other-")))
    model = F.concat(F.get(names, (F.col("n_nationkey") % 6).cast("int")), F.col("n_nationkey").cast("string"))
    return C.table(spark, sf, "nation").select("n_nationkey", stubs.routed(model).alias("service"))


@query("e04_translated", "SELECT doc_id, md5(upper(replace(text, 'ß', 'SS'))) AS translation_md5 FROM documents")
def e04(spark, sf):
    return C.docs(spark, sf).select("doc_id", F.md5(stubs.translate(F.col("text"))).alias("translation_md5"))
