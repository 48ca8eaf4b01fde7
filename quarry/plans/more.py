"""Smaller queries that round off the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import parsers as P
from quarry.functions import text as X
from quarry.operators import corpus as O
from quarry.operators import enrichment as E
from quarry.operators import longctx as L
from quarry.operators import metrics as M
from quarry.operators import verify as V
from quarry.plans import common as C
from quarry.plans.longdocs import WORDS, built, texts
from quarry.plans.registry import query


@query("f02_path_parts", "SELECT doc_id FROM documents WHERE (contains(source, 'src1') OR contains(source, 'src2')) AND NOT contains(lower(source), 'src12')")
def f02(spark, sf):
    return C.docs(spark, sf).where((F.contains("source", F.lit("src1")) | F.contains("source", F.lit("src2"))) & ~F.contains(F.lower("source"), F.lit("src12"))).select("doc_id")


@query("f04_blank_texts", "SELECT conv_id, turn, text IS NULL OR trim(text) = '' OR lower(trim(text)) = 'null' AS blank FROM conversations")
def f04(spark, sf):
    t = C.table(spark, sf, "conversations")
    kept = O.clean(t).select("conv_id", "turn", F.lit(False).alias("blank"))
    return t.join(kept, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("blank", F.lit(True)).alias("blank"))


@query("f05_positive_judgements", "WITH " + C.QRELS_SQL + " SELECT query_id, doc_id FROM qrels WHERE score > 0")
def f05(spark, sf):
    return C.qrels(spark, sf).where("score > 0").select("query_id", "doc_id")


@query("f11_baseline_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'")
def f11(spark, sf):
    return O.matching(C.table(spark, sf, "lineitem"), [{"l_returnflag": "A", "l_linestatus": "F"}]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f15_successes", "SELECT event_id FROM events WHERE event_type = 'purchase'")
def f15(spark, sf):
    return C.table(spark, sf, "events").where("event_type = 'purchase'").select("event_id")


@query("f16_errors_dropped", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def f16(spark, sf):
    v = F.concat(F.lit('{"key_term_lost": true, "retrieval_risk": "'), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise('low"}'))
    return C.table(spark, sf, "orders").where(~P.checked_verdict(v)["error"]).select("o_orderkey")


@query("p03_word_counts", "SELECT doc_id, " + WORDS.format("text") + " AS n FROM documents")
def p03(spark, sf):
    return texts(spark, sf).select("doc_id", X.word_count(F.col("text")).alias("n"))


@query("p06_length_ratios", "SELECT conv_id, turn, round(CASE WHEN length(text) > 0 THEN length(role) / length(text) ELSE 0 END, 6) AS ratio FROM conversations")
def p06(spark, sf):
    return C.table(spark, sf, "conversations").select("conv_id", "turn", F.round(X.length_ratio(F.col("role"), F.col("text")), 6).alias("ratio"))


@query("p08_snapped_heads", """WITH c AS (SELECT doc_id, text, CASE WHEN length(text) <= 500 THEN -1 ELSE list_max(list_filter(generate_series(469, 501), lambda i: regexp_matches(substr(text, i, 1), '^\\s$'))) END AS space FROM documents)
SELECT doc_id, md5(CASE WHEN space = -1 THEN text WHEN space IS NULL THEN substr(text, 1, 500) ELSE substr(text, 1, space - 1) END) AS head_md5 FROM c""")
def p08(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(L.head(F.col("text"), F.lit(500))).alias("head_md5"))


@query("p11_part_at_offset", "WITH c AS (SELECT doc_id, text, substr(text, 11, 20) AS part, 11 + doc_id % 2 AS claimed FROM documents) SELECT doc_id, starts_with(substr(text, claimed), part) AS same FROM c")
def p11(spark, sf):
    """Whether a part stands where it is said to; of odd documents the place is one too far."""
    claimed = (F.lit(11) + F.col("doc_id") % 2).cast("int")
    return texts(spark, sf).select("doc_id", V.stands_at(F.col("text"), F.substring("text", 11, 20), claimed).alias("same"))


@query("p15_unescaped", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def p15(spark, sf):
    """Escaped texts come back whole."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("e"), F.lit("\\u0065"))
    return texts(spark, sf).select("doc_id", F.md5(P.unescape(escaped)).alias("text_md5"))


@query("p18_citations", "SELECT doc_id, md5(regexp_replace(replace(text, ' the ', ' [1][23] '), '(?:\\[\\d+\\])+', '', 'g')) AS t_md5 FROM documents")
def p18(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(X.strip_citations(F.replace("text", F.lit(" the "), F.lit(" [1][23] ")))).alias("t_md5"))


@query("p20_url_factors", "SELECT page_id, regexp_extract(url, '^(\\w+)://([^/?#]+)', 1) AS scheme, regexp_extract(url, '^(\\w+)://([^/?#]+)', 2) AS host, regexp_extract(url, '/(\\d+)', 1) AS number FROM pages")
def p20(spark, sf):
    part = lambda p, i: F.regexp_extract("url", p, i)
    return C.table(spark, sf, "pages").select("page_id", part("^(\\w+)://([^/?#]+)", 1).alias("scheme"), part("^(\\w+)://([^/?#]+)", 2).alias("host"), part("/(\\d+)", 1).alias("number"))


@query("t09_article_pairs", "SELECT doc_id, lang || ' ' || source AS anchor, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS positive FROM documents")
def t09(spark, sf):
    """Texts as the one section of a marked article, their lines as its paragraphs."""
    body = F.replace("text", F.lit("\n"), F.lit(P.NEWLINE))
    marked = F.concat(F.lit(P.ARTICLE), F.lit("\n"), "lang", F.lit(f"\n{P.SECTION}\n"), "source", F.lit(f"\n{P.PARAGRAPH}\n"), body)
    return C.docs(spark, sf).select("doc_id", P.article_pair(P.article(marked)).alias("p")).select("doc_id", "p.anchor", "p.positive")


@query("t13_optional_columns", "SELECT item_id, 'C: ' || text || ' / ' || item_id AS prompt FROM benchmark")
def t13(spark, sf):
    template = "C: {context_text} / {item_id}"
    rows = C.table(spark, sf, "benchmark").select("item_id", *([F.col("text").alias("context_text")] if "context_text" in E.placeholders(template) else []))
    return rows.select("item_id", E.rendered(template, rows.columns).alias("prompt"))


@query("j19_merged_annotations", "SELECT a.c_custkey, b.s_suppkey FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey")
def j19(spark, sf):
    a = C.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return a.join(C.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), "k").select("c_custkey", "s_suppkey")


@query("l02_dense_topk_scores", "WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) SELECT query_id, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM p) WHERE r <= 100 GROUP BY query_id")
def l02(spark, sf):
    from quarry.operators.dense import knn

    e = C.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    near = knn(e.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), e, 100)
    return near.groupBy("query_id").agg(F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"))


@query("l08_sorted_by_size", "SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*), source) AS place FROM documents GROUP BY source")
def l08(spark, sf):
    sizes = C.docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    return sizes.withColumn("place", F.row_number().over(Window.orderBy("n", "source")).cast("long"))


SIDES_SQL = """p AS (SELECT source, doc_id, length(text) + 2 AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents),
k AS (SELECT *, place % 2 AS side, coalesce(sum(n) OVER (PARTITION BY source, place % 2 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)"""


@query("r06_tapes", "WITH " + SIDES_SQL + " SELECT source, CAST(greatest(0, coalesce(sum(CASE WHEN side = 0 THEN n END), 2) - 2) AS BIGINT) AS left_chars, CAST(greatest(0, coalesce(sum(CASE WHEN side = 1 THEN n END), 2) - 2) AS BIGINT) AS right_chars, count(*) AS n_passages FROM k WHERE before < 5000 GROUP BY source")
def r06(spark, sf):
    """Lengths of both tapes of each source's documents in order, and how many passages they are made of."""
    d = C.docs(spark, sf).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("nth"), F.col("doc_id").alias("pid"), F.length("text").cast("long").alias("n_chars"))
    made = L.tapes(L.dealt(d, 5000), texts(spark, sf).withColumnRenamed("doc_id", "pid"))
    return made.select(F.col("doc_id").alias("source"), F.length("left").cast("long").alias("left_chars"), F.length("right").cast("long").alias("right_chars"), F.size("ids").cast("long").alias("n_passages"))


@query("r11_legacy_documents")
def r11(spark, sf):
    d = C.docs(spark, sf)
    first = d.groupBy("source").agg(F.min("doc_id").alias("nth"))
    golds = d.join(first.select(F.col("nth").alias("doc_id")), "doc_id", "left_semi").select(F.col("source").alias("doc_id"), "text")
    rest = d.join(first.select(F.col("nth").alias("doc_id")), "doc_id", "left_anti").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("nth"), "text")
    out = L.legacy_documents(golds, rest, 512, 0.5)
    return out.select(F.col("doc_id").alias("source"), X.word_count(F.col("text")).alias("n_tokens"), "first", "last")


@query("r15_documents_from_windows", "WITH w AS (SELECT l_suppkey % 20 AS query_id, l_partkey % 100 AS doc_id, l_extendedprice AS score FROM lineitem), d AS (SELECT query_id, doc_id, round(avg(score), 4) AS score FROM w GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM d QUALIFY rank <= 5")
def r15(spark, sf):
    from quarry.operators.lexical import top_k

    w = C.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("query_id"), (F.col("l_partkey") % 100).alias("doc_id"), F.col("l_extendedprice").alias("score"))
    return top_k(M.pool_windows(w, "mean").withColumn("score", F.round("score", 4)), 5)


def check(name, *arguments, facts=()):
    """A check of the welded documents, alone; facts: what the build itself finds for it."""

    @query(name)
    def run(spark, sf):
        made = dict(zip(("welded", "seeds", "qrels"), built(spark, sf, facts=facts)))
        return arguments[0](*(made[a] for a in arguments[1:]))

    run.__doc__ = arguments[0].__doc__
    return run


check("v02_gold_once", V.gold_once, "welded", "seeds", facts=("gold_once",))
check("v03_budget", V.filled, "welded")
check("v04_separator", V.separated, "welded")
check("v05_newlines", V.has_newline, "welded")
check("v06_position_spread", V.spread, "welded")
check("v07_bins", V.balanced, "welded")
check("v12_nesting", V.nested, "welded", facts=("nests",))


@query("x07_insert_or_ignore", "SELECT count(*) AS n FROM (SELECT md5(text) AS k FROM documents WHERE doc_id % 2 = 0 UNION SELECT md5(text) FROM documents)")
def x07(spark, sf):
    keys = C.docs(spark, sf).select(F.md5("text").alias("key"), "doc_id", F.lit("t").alias("translation"))
    cache = keys.where("doc_id % 2 = 0").select("key").distinct()
    return cache.unionByName(E.to_insert(keys, cache, "doc_id").select("key")).agg(F.count("*").alias("n"))


@query("x08_latest_by_name", "SELECT o_custkey, max(o_orderpriority || '/' || o_orderkey) AS latest FROM orders GROUP BY o_custkey")
def x08(spark, sf):
    return C.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.concat_ws("/", "o_orderpriority", "o_orderkey")).alias("latest"))


@query("e08_windows_of_each_document", "SELECT doc_id, 1 + greatest(0, ceil((" + WORDS.format("text") + " - 126) / 95))::BIGINT AS n_windows FROM documents")
def e08(spark, sf):
    return L.fixed_windows(texts(spark, sf), 128).groupBy("doc_id").agg(F.count("*").alias("n_windows"))
