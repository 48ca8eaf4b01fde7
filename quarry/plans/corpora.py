"""Queries of corpus building: projections, filters, dedup, samples, budgets, shards and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import hashing as H
from quarry.functions import text as X
from quarry.operators import corpus as O
from quarry.plans import common as C
from quarry.plans.registry import query

SEED = "('0x' || substr(sha256({0}), 1, 16))::UBIGINT"
GLOBAL = f"'{H.GLOBAL_SEED}' || chr(31) || "
KEYED = SEED.format(GLOBAL + "doc_id")


def d(spark, sf):
    return C.docs(spark, sf)


def digest(*columns):
    """Ids and digests in place of whole texts."""
    return [F.md5(c).alias(f"{c}_md5") for c in columns]


@query("t01_join_title_text", "SELECT doc_id, md5(concat_ws(' ', nullif(trim(split_part(text, chr(10), 1)), ''), nullif(trim(source), ''))) AS joined_md5 FROM documents")
def t01(spark, sf):
    return d(spark, sf).select("doc_id", F.md5(X.join_title_text(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("source"))).alias("joined_md5"))


@query("t02_provenance", "SELECT doc_id, lang, source, 'documents' AS _source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS _row_number FROM documents")
def t02(spark, sf):
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long") - 1
    rows = d(spark, sf).withColumnsRenamed({"lang": "LANG", "source": "SOURCE"})
    rows = rows.toDF(*(c.lower() for c in rows.columns))
    return rows.select("doc_id", "lang", "source", F.lit("documents").alias("_source"), nth.alias("_row_number"))


@query("t03_guid", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE sha256(text) END AS guid FROM documents")
def t03(spark, sf):
    return d(spark, sf).select("doc_id", H.guid(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")), F.col("text")).alias("guid"))


@query("t04_context_hash", "SELECT doc_id, md5(text) AS context_hash FROM documents")
def t04(spark, sf):
    return d(spark, sf).select("doc_id", F.md5("text").alias("context_hash"))


@query("t05_kept_fields", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS text_md5, source FROM documents")
def t05(spark, sf):
    return d(spark, sf).select(F.col("doc_id").cast("string").alias("id"), *digest("text"), "source")


@query("t06_prefixes", "SELECT item_id, '[' || CASE WHEN item_id % 2 = 0 THEN 'search' ELSE 'qa' END || '] query: ' || text AS query, 'passage: ' || text AS passage FROM benchmark")
def t06(spark, sf):
    task = F.when(F.col("item_id") % 2 == 0, "search").otherwise("qa")
    return C.table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("["), task, F.lit("] query: "), "text").alias("query"), F.concat(F.lit("passage: "), "text").alias("passage"))


QA_SQL = "qa AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"


def pairs(spark, sf):
    t = C.table(spark, sf, "conversations")
    u = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"], "left")


@query("t07_question_answers", "WITH " + QA_SQL + " SELECT conv_id, turn, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM qa")
def t07(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", *digest("question", "answer"))


@query("w07_one_question_each", "WITH " + QA_SQL + f" SELECT conv_id, arg_min(turn, {SEED.format(GLOBAL + 'conv_id || chr(31) || turn')}) AS turn, count(*) AS n FROM qa GROUP BY conv_id")
def w07(spark, sf):
    seed = H.seed64(F.lit(H.GLOBAL_SEED), F.col("conv_id"), F.col("turn"))
    return pairs(spark, sf).groupBy("conv_id").agg(F.min_by("turn", seed).alias("turn"), F.count("*").alias("n"))


@query("t08_pair_views", "WITH " + QA_SQL + " SELECT 'question' AS kind, conv_id, md5(question) AS a_md5, md5(answer) AS b_md5 FROM qa UNION ALL SELECT 'role', conv_id, md5('user'), md5(question) FROM qa")
def t08(spark, sf):
    q = pairs(spark, sf)
    return q.select(F.lit("question").alias("kind"), "conv_id", F.md5("question").alias("a_md5"), F.md5("answer").alias("b_md5")).unionAll(q.select(F.lit("role"), "conv_id", F.md5(F.lit("user")), F.md5("question")))


@query("t10_triples", "WITH " + QA_SQL + " SELECT conv_id, turn, 'query: ' || question AS anchor, 'passage: ' || coalesce(answer, '') AS positive FROM qa")
def t10(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", F.concat(F.lit("query: "), "question").alias("anchor"), F.concat(F.lit("passage: "), F.coalesce("answer", F.lit(""))).alias("positive"))


@query("t11_entailment_pairs", "SELECT l_orderkey AS a, l_partkey AS b, 1.0::DOUBLE AS label FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, l_orderkey, 0.0::DOUBLE FROM lineitem WHERE l_returnflag = 'R'")
def t11(spark, sf):
    t = C.table(spark, sf, "lineitem")
    yes = t.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.lit(1.0).alias("label"))
    return yes.unionAll(t.where("l_returnflag = 'R'").select("l_partkey", "l_orderkey", F.lit(0.0)))


@query("t12_rendered_prompt", "SELECT item_id, 'Be brief.' || chr(10) || 'Translate: ' || text || ' (id ' || item_id || ', {unknown})' AS prompt FROM benchmark")
def t12(spark, sf):
    from quarry.operators.enrichment import rendered

    t = C.table(spark, sf, "benchmark")
    return t.select("item_id", rendered("Translate: {text} (id {item_id}, {unknown})", t.columns, "Be brief.").alias("prompt"))


@query("t15_filled_negatives", "WITH " + QA_SQL + " SELECT conv_id, turn, coalesce(md5(answer), md5(question)) AS negative FROM qa")
def t15(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", F.md5(F.coalesce("answer", "question")).alias("negative"))


@query("t16_composite_id", "SELECT l_orderkey || '__' || l_linenumber AS row_id, l_quantity FROM lineitem")
def t16(spark, sf):
    from quarry.operators.enrichment import row_id

    rows = C.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("_id"), F.col("l_linenumber").alias("segment_id"), "l_quantity")
    return rows.select(row_id(rows).alias("row_id"), "l_quantity")


@query("t17_paragraphs", "SELECT doc_id, md5(p) AS paragraph_md5 FROM (SELECT doc_id, source, regexp_replace(unnest(string_split(text, chr(10))), '(?:\\[\\d+\\])+', '', 'g') AS p FROM documents) WHERE length(p) > 100 OR source = 'src1'")
def t17(spark, sf):
    rows = d(spark, sf).select("doc_id", "source", F.explode(F.split("text", "\n")).alias("p")).withColumn("p", X.strip_citations(F.col("p")))
    return rows.where((F.length("p") > 100) | (F.col("source") == "src1")).select("doc_id", F.md5("p").alias("paragraph_md5"))


@query("t18_clipped_words", "SELECT doc_id, md5(array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1, 64), ' ')) AS clip_md5 FROM documents")
def t18(spark, sf):
    return d(spark, sf).select("doc_id", F.md5(X.clip_words(F.col("text"), 64)).alias("clip_md5"))


@query("t19_clipped_text", "SELECT doc_id, md5(substr(text, 1, 2500)) AS clip_md5 FROM documents")
def t19(spark, sf):
    return d(spark, sf).select("doc_id", F.md5(F.substring("text", 1, 2500)).alias("clip_md5"))


@query("t20_slugs", "SELECT p_partkey, trim(regexp_replace(replace(lower(p_type || '/' || p_brand), '/', '_'), '[^a-z0-9_]+', '-', 'g'), '-') AS slug FROM part")
def t20(spark, sf):
    return C.table(spark, sf, "part").select("p_partkey", X.slug(F.concat_ws("/", "p_type", "p_brand")).alias("slug"))


@query("t21_categories", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Science' WHEN 'MACHINERY' THEN 'Finance' ELSE 'Unknown' END AS category FROM customer")
def t21(spark, sf):
    from quarry.operators.enrichment import category

    slug = F.when(F.col("c_mktsegment") == "BUILDING", "scifact").when(F.col("c_mktsegment") == "MACHINERY", "fiqa").otherwise(F.col("c_mktsegment"))
    return C.table(spark, sf, "customer").select("c_custkey", category(slug).alias("category"))


@query("t22_length_bucket", "SELECT l_orderkey, l_linenumber, CASE WHEN max(l_linenumber - 1) OVER (PARTITION BY l_orderkey) >= 3 THEN 'long' ELSE 'short' END AS bucket FROM lineitem")
def t22(spark, sf):
    from quarry.operators.enrichment import length_bucket

    rows = C.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.floor((F.col("l_linenumber") - 1) / 3).alias("segment_id"))
    return length_bucket(rows, ["l_orderkey"]).select("l_orderkey", "l_linenumber", F.col("text_length_bucket").alias("bucket"))


@query("f01_criteria_union", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND source = 'src1' UNION ALL SELECT doc_id, source FROM documents WHERE source = 'src1'")
def f01(spark, sf):
    return O.matching(d(spark, sf).select("doc_id", "source", "lang"), [{"lang": "en", "source": "src1"}, {"source": "src1"}]).select("doc_id", "source")


@query("f03_length_bounds", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND lower(trim(text)) <> 'null' AND length(text) BETWEEN 200 AND 3000")
def f03(spark, sf):
    return O.clean(d(spark, sf), least=200, most=3000).select("doc_id")


@query("f08_failed_translations", "SELECT doc_id, length(t) < 0.5 * length(text) AND length(text) >= 200 OR t IS NULL OR trim(t) = '' AS failed FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN substr(text, 1, 100) ELSE upper(text) END AS t FROM documents)")
def f08(spark, sf):
    from quarry.operators.enrichment import failed

    m = F.col("doc_id") % 4
    t = F.when(m == 1, "").when(m == 2, F.substring("text", 1, 100)).when(m == 3, F.upper("text"))
    return d(spark, sf).select("doc_id", failed(F.col("text"), t).alias("failed"))


@query("f09_pending", "SELECT conv_id, turn FROM conversations WHERE nullif(role, 'user') IS NULL")
def f09(spark, sf):
    return C.table(spark, sf, "conversations").where(F.nullif("role", F.lit("user")).isNull()).select("conv_id", "turn")


@query("f10_excluded_prompts", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_linestatus = 'O' AND l_returnflag IN ('A', 'R'))")
def f10(spark, sf):
    return C.table(spark, sf, "lineitem").where(~((F.col("l_linestatus") == "O") & F.col("l_returnflag").isin("A", "R"))).select("l_orderkey", "l_linenumber")


@query("f12_hash_split", f"SELECT doc_id, CASE WHEN {KEYED}::DOUBLE / 18446744073709551616.0 < 0.1 THEN 'validation' ELSE 'train' END AS split FROM documents")
def f12(spark, sf):
    return O.split(d(spark, sf), "doc_id", 0.1).select("doc_id", "split")


@query("f13_partial_names", "SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), lower('SUPPLIER#0000000'))")
def f13(spark, sf):
    return C.table(spark, sf, "supplier").where(F.contains(F.lower("s_name"), F.lower(F.lit("SUPPLIER#0000000")))).select("s_suppkey")


@query("f14_fits_budget", "SELECT doc_id FROM documents WHERE length(text) + 2 * 2 <= 3700")
def f14(spark, sf):
    return d(spark, sf).where(F.length("text") + 2 * 2 <= 3700).select("doc_id")


@query("f17_long_documents", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_tokens FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 512")
def f17(spark, sf):
    return d(spark, sf).select("doc_id", X.word_count(F.col("text")).alias("n_tokens")).where("n_tokens > 512")


@query("w04_first_of_text", "SELECT doc_id, md5(text) AS guid FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def w04(spark, sf):
    return O.first_of(d(spark, sf).select("doc_id", F.md5("text").alias("guid")), ["guid"], ["doc_id"])


@query("w05_preferred_source", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY source <> 'src0', doc_id) = 1")
def w05(spark, sf):
    return O.preferred_first(d(spark, sf).select("doc_id", "source", F.md5("text").alias("g")), ["g"], "source", "src0", ["doc_id"]).select("doc_id", "source")


@query("w06_representatives", "SELECT source, min(doc_id) AS doc_id, md5(arg_min(text, doc_id)) AS text_md5, count(*) AS n FROM documents GROUP BY source")
def w06(spark, sf):
    return d(spark, sf).groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.md5(F.min_by("text", "doc_id")).alias("text_md5"), F.count("*").alias("n"))


@query("a31_duplicates", "SELECT md5(text) AS g, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id), ',') AS members FROM documents GROUP BY text HAVING count(*) > 1")
def a31(spark, sf):
    return O.duplicates(d(spark, sf).select("doc_id", F.md5("text").alias("g")), "g", "doc_id").select("g", "n", F.array_join("members", ",").alias("members"))


@query("w09_token_budget", "SELECT doc_id, n_chars FROM documents QUALIFY sum(n_chars) OVER (ORDER BY doc_id) <= 500000")
def w09(spark, sf):
    return O.within_budget(d(spark, sf).select("doc_id", "n_chars"), "n_chars", 500_000, "doc_id")


@query("w10_running_totals", "SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS running FROM documents")
def w10(spark, sf):
    return O.running(d(spark, sf).select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "running")


@query("w16_row_index", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_index FROM documents")
def w16(spark, sf):
    return d(spark, sf).select("doc_id", "source", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long") - 1).alias("row_index"))


@query("l06_first_rows", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25")
def l06(spark, sf):
    return d(spark, sf).select("doc_id", "source").orderBy("doc_id").limit(25)


@query("l09_batches", "SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) / 8) AS BIGINT) AS batch FROM documents")
def l09(spark, sf):
    return O.shards(d(spark, sf).select("doc_id", "source", "n_chars"), 8, ["n_chars", "doc_id"], by=["source"]).select("doc_id", F.col("shard").alias("batch"))


@query("l10_seeded_sample", f"SELECT doc_id FROM documents ORDER BY {KEYED}, doc_id LIMIT 100")
def l10(spark, sf):
    return O.sample(d(spark, sf).select("doc_id"), 100, "doc_id")


@query("l11_sample_of_each_file", f"SELECT doc_id, source FROM documents WHERE length(text) >= 100 QUALIFY row_number() OVER (PARTITION BY source ORDER BY {KEYED}, doc_id) <= 5")
def l11(spark, sf):
    return O.sample(O.clean(d(spark, sf), least=100).select("doc_id", "source"), 5, "doc_id", by=["source"])


@query("l13_weighted_rungs", f"SELECT doc_id, CASE WHEN u < 0.3 THEN 3700 WHEN u < 0.55 THEN 7400 WHEN u < 0.75 THEN 11800 WHEN u < 0.9 THEN 19000 ELSE 27000 END AS rung FROM (SELECT doc_id, {KEYED}::DOUBLE / 18446744073709551616.0 AS u FROM documents)")
def l13(spark, sf):
    return d(spark, sf).select("doc_id", O.weighted_choice(F.col("doc_id"), [3700, 7400, 11800, 19000, 27000], [0.30, 0.25, 0.20, 0.15, 0.10]).alias("rung"))


@query("l14_shuffled", f"SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {KEYED}) AS place FROM documents")
def l14(spark, sf):
    seed = H.seed64(F.lit(H.GLOBAL_SEED), F.col("doc_id"))
    return d(spark, sf).select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(seed)).cast("long").alias("place"))


@query("l15_interleaved", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents")
def l15(spark, sf):
    return O.interleave(d(spark, sf).select("doc_id", "lang"), "lang", ["doc_id"])


@query("l16_exact_split", f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {KEYED}, doc_id) AS p, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN p > ceil(0.1 * n) THEN 'train' WHEN p > ceil(0.1 * n) // 2 THEN 'test' ELSE 'validation' END AS split FROM r")
def l16(spark, sf):
    return O.split_exact(d(spark, sf).select("doc_id"), "doc_id", 0.1)


@query("l17_matched_controls", f"""WITH g AS (SELECT doc_id, source, CASE WHEN n_chars % 5 = 0 THEN 'loss' WHEN n_chars % 5 < 3 THEN 'control' ELSE 'none' END AS grp FROM documents),
w AS (SELECT source, count(*) AS n FROM g WHERE grp = 'loss' GROUP BY source)
SELECT doc_id, source, grp FROM g WHERE grp = 'loss' UNION ALL SELECT doc_id, source, grp FROM (SELECT g.*, n, row_number() OVER (PARTITION BY g.source ORDER BY {KEYED}, doc_id) AS nth FROM g JOIN w USING (source) WHERE grp = 'control') WHERE nth <= n""")
def l17(spark, sf):
    m = F.col("n_chars") % 5
    rows = d(spark, sf).select("doc_id", "source", F.when(m == 0, "loss").when(m < 3, "control").otherwise("none").alias("grp"))
    return O.matched_controls(rows, "grp", "loss", "control", ["source"], "doc_id").select("doc_id", "source", "grp")


@query("l18_cadence", "SELECT r AS shard, r // 3 AS static, CAST(floor((-1 + sqrt(1 + 4 * r)) / 2 + 1e-9) AS BIGINT) AS linear, CAST(floor(log2(r + 1) + 1e-9) AS BIGINT) AS exponential FROM (SELECT doc_id AS r FROM documents WHERE doc_id < 64)")
def l18(spark, sf):
    r = F.col("doc_id")
    return d(spark, sf).where("doc_id < 64").select(r.alias("shard"), O.cadence(r, "static", 3).alias("static"), O.cadence(r, "linear", 2, 2).alias("linear"), O.cadence(r, "exponential", 1).alias("exponential"))


@query("k04_sharded_manifest", "SELECT 'documents' AS type, s AS index, count(*) AS rows FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS s FROM documents) GROUP BY s")
def k04(spark, sf):
    return O.manifest(O.shards(d(spark, sf).select("doc_id"), 64, ["doc_id"]), "documents")


@query("a25_manifest_totals", "SELECT count(*) AS shards, CAST(sum(rows) AS BIGINT) AS rows FROM (SELECT s, count(*) AS rows FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS s FROM documents) GROUP BY s)")
def a25(spark, sf):
    return k04(spark, sf).agg(F.count("*").alias("shards"), F.sum("rows").alias("rows"))


@query("u01_union_by_name", "SELECT doc_id AS id, lang, CAST(NULL AS VARCHAR) AS role FROM documents UNION ALL SELECT conv_id, NULL, role FROM conversations")
def u01(spark, sf):
    a = d(spark, sf).select(F.col("doc_id").alias("id"), "lang")
    return a.unionByName(C.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "role"), allowMissingColumns=True)


@query("u02_union_of_positives", "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def u02(spark, sf):
    t = C.table(spark, sf, "lineitem")
    a, b = (t.where(F.col("l_returnflag") == f).select("l_orderkey", "l_suppkey") for f in "AR")
    return a.union(b).distinct()


@query("u03_id_differences", "SELECT 'added' AS side, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'dropped', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def u03(spark, sf):
    a, b = d(spark, sf).select("doc_id"), C.table(spark, sf, "labels").select("doc_id")
    added = a.exceptAll(b).select(F.lit("added").alias("side"), F.col("doc_id").alias("id"))
    return added.unionAll(b.join(a.where("doc_id % 2 = 0"), "doc_id", "left_anti").select(F.lit("dropped"), "doc_id"))


@query("u04_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u04(spark, sf):
    return d(spark, sf).select("doc_id").intersect(C.table(spark, sf, "labels").select("doc_id"))


@query("u05_distinct_texts", "SELECT DISTINCT md5(text) AS text_md5 FROM documents")
def u05(spark, sf):
    return d(spark, sf).select(F.md5("text").alias("text_md5")).dropDuplicates(["text_md5"])


@query("u06_distinct_titles", "SELECT source, arg_min(trim(lang), doc_id) AS title FROM documents WHERE trim(lang) <> '' GROUP BY source")
def u06(spark, sf):
    return O.first_of(d(spark, sf).where("trim(lang) <> ''").select("source", "doc_id", F.trim("lang").alias("title")), ["source"], ["doc_id"]).select("source", "title")


@query("p02_word_tokens", "SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents)")
def p02(spark, sf):
    t = d(spark, sf).select("doc_id", X.unicode_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("p04_character_classes", "SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^\\x{05D0}-\\x{05EA}]', '', 'g')) AS hebrew, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text), 6) AS latin_share FROM documents")
def p04(spark, sf):
    latin = X.count_of(F.col("text"), "[A-Za-z]")
    return d(spark, sf).select("doc_id", latin.alias("latin"), X.count_of(F.col("text"), "[\\u05D0-\\u05EA]").alias("hebrew"), F.round(latin / F.length("text"), 6).alias("latin_share"))


@query("p05_numbers", "SELECT doc_id, len(n) AS n_numbers, array_to_string(n, ' ') AS numbers FROM (SELECT doc_id, regexp_extract_all(text, '\\d+(?:[.,]\\d+)?') AS n FROM documents)")
def p05(spark, sf):
    n = X.numbers(F.col("text"))
    return d(spark, sf).select("doc_id", F.size(n).cast("long").alias("n_numbers"), F.array_join(n, " ").alias("numbers"))


@query("p07_hashes", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, CAST(" + SEED.format("CAST(doc_id AS VARCHAR)") + " AS VARCHAR) AS seed, ['start', 'middle', 'end'][CAST(" + SEED.format("CAST(doc_id AS VARCHAR)") + " % 3 AS INT) + 1] AS bin FROM documents")
def p07(spark, sf):
    return d(spark, sf).select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), H.seed64(F.col("doc_id")).cast("string").alias("seed"), H.stable_bin(F.col("doc_id"), ["start", "middle", "end"]).alias("bin"))


@query("p10_space_places", "SELECT doc_id, CASE WHEN contains(h, ' ') THEN length(h) - strpos(reverse(h), ' ') + 1 ELSE 0 END AS last_space, CASE WHEN strpos(t, ' ') = 0 THEN 0 ELSE strpos(t, ' ') + 99 END AS first_space FROM (SELECT doc_id, regexp_replace(substr(text, 1, 100), '\\s', ' ', 'g') AS h, regexp_replace(substr(text, 100), '\\s', ' ', 'g') AS t FROM documents)")
def p10(spark, sf):
    return d(spark, sf).select("doc_id", X.last_space(F.col("text"), F.lit(100)).cast("long").alias("last_space"), X.first_space(F.col("text"), F.lit(100)).cast("long").alias("first_space"))


@query("p12_occurrences", "SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents")
def p12(spark, sf):
    return d(spark, sf).select("doc_id", X.occurrences(F.col("text"), F.lit("the")).alias("n"))


@query("p13_paragraph_counts", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents")
def p13(spark, sf):
    return d(spark, sf).select("doc_id", F.size(X.paragraphs(F.col("text"))).cast("long").alias("n"))


@query("p19_sizes", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 1000 WHEN 2 THEN o_custkey * 1000000 END AS n FROM orders")
def p19(spark, sf):
    m = F.col("o_orderkey") % 4
    given = F.concat(F.col("o_custkey").cast("string"), F.when(m == 0, "").when(m == 1, "K").when(m == 2, "m").otherwise("x"))
    return C.table(spark, sf, "orders").select("o_orderkey", X.size_number(given).alias("n"))


@query("p21_nested_json", "SELECT event_id, json_extract_string(props, '$.page') AS page, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def p21(spark, sf):
    return C.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("p22_slices", "SELECT conv_id, array_to_string(list_slice(t, 1, 2), ',') AS first_two, coalesce(CAST(t[5] AS VARCHAR), '') AS fifth FROM (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id)")
def p22(spark, sf):
    t = C.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return t.select("conv_id", F.array_join(F.slice("t", 1, 2), ",").alias("first_two"), F.coalesce(F.get("t", F.lit(4)).cast("string"), F.lit("")).alias("fifth"))


@query("p23_elapsed", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days FROM orders")
def p23(spark, sf):
    return C.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("days"))


@query("p24_gains", "SELECT l_orderkey, l_linenumber, round(l_linenumber / log2(l_linenumber + 1), 6) AS linear, round((pow(2, l_linenumber) - 1) / log2(l_linenumber + 1), 6) AS exponential FROM lineitem")
def p24(spark, sf):
    from quarry.functions.vectors import discount, gain

    n = F.col("l_linenumber")
    return C.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(gain(n) * discount(n), 6).alias("linear"), F.round(gain(n, True) * discount(n), 6).alias("exponential"))


@query("p25_unit_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm2 FROM embeddings")
def p25(spark, sf):
    from quarry.functions.vectors import dot, normalise

    v = F.col("embedding")
    return C.table(spark, sf, "embeddings").select("vec_id", F.round(dot(normalise(v), normalise(v)) * dot(v, v), 6).alias("norm2"))


@query("a23_token_totals", "SELECT source, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS n_tokens FROM documents GROUP BY source")
def a23(spark, sf):
    return d(spark, sf).groupBy("source").agg(F.sum(X.word_count(F.col("text"))).alias("n_tokens"))


@query("a22_compression", "SELECT CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS n_tokens, round(sum(length(text)) / sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))), 6) AS chars_per_token FROM documents")
def a22(spark, sf):
    from quarry.operators.analysis import compression

    out = compression(d(spark, sf), F.length("text").cast("long"), X.word_count(F.col("text")))
    return out.withColumn("chars_per_token", F.round("chars_per_token", 6))


@query("x01_content_keys", "SELECT doc_id, sha256('m' || chr(0) || 'p' || chr(0) || text || chr(0) || lang) AS key FROM documents")
def x01(spark, sf):
    return d(spark, sf).select("doc_id", H.content_key(F.lit("m"), F.lit("p"), F.col("text"), F.col("lang")).alias("key"))


# ---- joins ------------------------------------------------------------------------------------------


@query("j02_first_context", "WITH q AS (SELECT c_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderpriority, o_orderkey) AS nth FROM customer JOIN orders ON o_custkey = c_custkey) SELECT query_id, doc_id AS context_id FROM q WHERE nth = 1")
def j02(spark, sf):
    from quarry.operators.enrichment import with_context

    o = C.table(spark, sf, "orders")
    judged = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("split_no"), F.col("o_orderkey").alias("pos"))
    asked = C.table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("text"))
    return with_context(asked, judged, o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("text"))).select("query_id", "context_id")


@query("j03_predictions_by_id", "SELECT o_orderkey || '__' || o_custkey AS row_id, CASE WHEN o_custkey % 3 > 0 THEN 't' || o_custkey END AS translation FROM orders")
def j03(spark, sf):
    from quarry.operators.enrichment import matched

    rows = C.table(spark, sf, "orders").select(F.concat_ws("__", "o_orderkey", "o_custkey").alias("row_id"), "o_custkey", F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("translation"))
    return matched(rows.where("o_custkey % 3 > 0").select("row_id", "translation"), rows.select("row_id", "translation"), "row_id")


@query("j05_texts_that_are_queries", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE trim(b.text) = trim(d.text))")
def j05(spark, sf):
    asked = C.table(spark, sf, "benchmark").select(F.trim("text").alias("t"))
    return d(spark, sf).join(asked, F.trim("text") == F.col("t"), "left_semi").select("doc_id")


@query("j06_overwritten", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'new' END, c_mktsegment) AS segment FROM customer")
def j06(spark, sf):
    old = C.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return O.upsert(old, old.where("c_custkey % 3 = 0").withColumn("segment", F.lit("new")), ["c_custkey"], ["segment"])


@query("j07_attached_gold", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def j07(spark, sf):
    return C.table(spark, sf, "customer").join(C.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("j08_restored_rows", "SELECT doc_id, md5(CASE WHEN doc_id % 5 <> 0 THEN reverse(text) END) AS translation_md5 FROM documents")
def j08(spark, sf):
    from quarry.operators.enrichment import restored

    rows = d(spark, sf).select("doc_id", "text")
    return restored(rows, rows.where("doc_id % 5 <> 0").select("doc_id", F.reverse("text").alias("translation")), ["doc_id"]).select("doc_id", F.md5("translation").alias("translation_md5"))


@query("j09_titles", "SELECT doc_id, upper(trim(source)) AS title_translation FROM documents")
def j09(spark, sf):
    from quarry.functions.stubs import translate
    from quarry.operators.enrichment import unique_titles

    return unique_titles(d(spark, sf).select("doc_id", F.col("source").alias("title")), translate).select("doc_id", "title_translation")


@query("j12_equal_texts", "SELECT doc_id, min(doc_id) OVER w AS class, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY text)")
def j12(spark, sf):
    """Each document with the class of equal texts it is in, named by its least id, and how many there are."""
    rows = d(spark, sf).select("doc_id", F.sha2("text", 256).alias("h"))
    classes = rows.groupBy("h").agg(F.min("doc_id").alias("class"), F.count("*").alias("copies"))
    return rows.join(classes, "h").select("doc_id", "class", "copies")


@query("j18_baselines", "WITH b AS (SELECT l_returnflag AS f, round(avg(l_quantity), 4) AS mean FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), g AS (SELECT l_returnflag AS f, round(avg(l_quantity), 4) AS own FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT g.f, own, mean AS base FROM g LEFT JOIN b USING (f)")
def j18(spark, sf):
    t = C.table(spark, sf, "lineitem")
    mean = lambda s, name: t.where(F.col("l_linestatus") == s).groupBy(F.col("l_returnflag").alias("f")).agg(F.round(F.avg("l_quantity"), 4).alias(name))
    return mean("F", "own").join(mean("O", "base"), "f", "left")


@query("j20_full_outer", "SELECT coalesce(a.k, b.k) AS k, x, y FROM (SELECT c_nationkey AS k, count(*) AS x FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS y FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1) b ON a.k = b.k")
def j20(spark, sf):
    a = C.table(spark, sf, "customer").where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("x"))
    b = C.table(spark, sf, "supplier").where("s_nationkey % 3 = 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("y"))
    return a.join(b, "k", "full_outer")


@query("j21_unrescued", "SELECT DISTINCT l_orderkey AS query_id FROM lineitem a WHERE l_returnflag = 'N' AND NOT l_quantity > 20 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag <> 'N' AND b.l_quantity > 20)")
def j21(spark, sf):
    from quarry.operators.analysis import rescue

    return rescue(C.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_orderkey").alias("query_id"), (F.col("l_quantity") > 20).alias("hit")), "N")


@query("j24_zipped_by_place", "SELECT p_partkey, upper(p_name) AS answer FROM part")
def j24(spark, sf):
    """Answers that come back by place only, given to the rows they were made for."""
    from quarry.operators.corpus import numbered
    from quarry.operators.enrichment import zipped

    rows = numbered(C.table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "position")
    return zipped(rows.select("position", F.upper("p_name").alias("answer")), rows.select("position", "p_partkey")).select("p_partkey", "answer")


@query("j17_worst_signals", "SELECT l_orderkey AS query_id, min(p_size) AS len_ratio, max(p_retailprice) AS latin_residue, min(p_retailprice) AS hebrew_frac, min(p_size % 10) AS digit_jaccard FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def j17(spark, sf):
    from quarry.operators.enrichment import worst_signals

    links = C.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"))
    price = F.col("p_retailprice")
    return worst_signals(links, C.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("len_ratio"), price.alias("latin_residue"), price.alias("hebrew_frac"), (F.col("p_size") % 10).alias("digit_jaccard")))
