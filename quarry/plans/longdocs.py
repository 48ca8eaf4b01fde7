"""Queries of filler pools, welding, its verification, windows, and incremental enrichment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import hashing as H
from quarry.functions import parsers, stubs
from quarry.functions import text as X
from quarry.operators import enrichment as E
from quarry.operators import longctx as L
from quarry.operators import rings as R
from quarry.operators import verify as V
from quarry.plans import common as C
from quarry.plans.registry import query

SEED = "('0x' || substr(sha256({0}), 1, 16))::UBIGINT"
WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''))"
GLOBAL = f"'{H.GLOBAL_SEED}' || chr(31) || "


def texts(spark, sf):
    return C.docs(spark, sf).select("doc_id", "text")


POOL_SQL = C.QRELS_SQL + """, pool AS (SELECT doc_id AS pid, text, length(text) AS n_chars FROM documents d WHERE length(text) >= 100
  AND NOT EXISTS (SELECT 1 FROM qrels q WHERE q.score > 0 AND q.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE trim(b.text) = trim(d.text)))"""


def pool(spark, sf):
    return L.safe_pool(texts(spark, sf), C.questions(spark, sf), C.qrels(spark, sf))


@query("f06_safe_pool", "WITH " + POOL_SQL + " SELECT pid, n_chars FROM pool")
def f06(spark, sf):
    return pool(spark, sf).select("pid", "n_chars")


@query("r05_pool_report", "WITH " + C.QRELS_SQL + """, w AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM qrels q WHERE q.score > 0 AND q.doc_id = d.doc_id) THEN 'positive' WHEN EXISTS (SELECT 1 FROM benchmark b WHERE trim(b.text) = trim(d.text)) THEN 'query_text' WHEN length(text) < 100 THEN 'short' ELSE 'safe' END AS why FROM documents d)
SELECT count(*) AS n_docs, count(CASE WHEN why = 'positive' THEN 1 END) AS n_positive, count(CASE WHEN why = 'query_text' THEN 1 END) AS n_query_text, count(CASE WHEN why = 'short' THEN 1 END) AS n_short, count(CASE WHEN why = 'safe' THEN 1 END) AS n_safe, round(100 * count(CASE WHEN why = 'safe' THEN 1 END) / count(*), 4) AS pct_safe FROM w""")
def r05(spark, sf):
    return L.pool_report(texts(spark, sf), C.questions(spark, sf), C.qrels(spark, sf))


@query("v17_pool_leaks", "WITH " + POOL_SQL + " SELECT p.pid FROM pool p JOIN qrels q ON q.doc_id = p.pid WHERE q.score > 0")
def v17(spark, sf):
    return L.leaks(pool(spark, sf), C.qrels(spark, sf)).select("pid")


@query("j04_not_positive", "WITH " + C.QRELS_SQL + " SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM qrels WHERE score > 0)")
def j04(spark, sf):
    return C.docs(spark, sf).join(C.qrels(spark, sf).where("score > 0"), "doc_id", "left_anti").select("doc_id")


RING_SQL = f"""sds AS (SELECT pid, {SEED.format(GLOBAL + "'random' || chr(31) || pid")} AS s FROM pool),
plc AS (SELECT pid, row_number() OVER (ORDER BY s // 288230376151711744, s, pid) - 1 AS place FROM sds), tot AS (SELECT count(*) AS n FROM pool),
wnt AS (SELECT doc_id, nth, ({SEED.format(GLOBAL + "'random' || chr(31) || doc_id")} % n + nth) % n AS place FROM (SELECT doc_id, n, unnest(generate_series(0, least(900, n) - 1)) AS nth FROM documents, tot)),
ring AS (SELECT doc_id, nth, pid FROM wnt JOIN plc USING (place))"""


@query("r07_ring_filler", "WITH " + POOL_SQL + ", " + RING_SQL + " SELECT doc_id, nth, pid FROM ring")
def r07(spark, sf):
    return L.ring(texts(spark, sf), pool(spark, sf), L.DRAWN)


HOLDS_SQL = """holds AS (SELECT o.doc_id, p.pid FROM documents o JOIN pool p ON p.pid <> o.doc_id AND length(o.text) >= 64 AND length(p.text) >= length(o.text) AND contains(p.text, o.text)
  WHERE len(list_filter(regexp_split_to_array(o.text, '\\s+'), lambda x: x <> '')) > 2)"""


@query("f07_own_text_excluded", "WITH " + POOL_SQL + ", " + RING_SQL + ", " + HOLDS_SQL + ", m AS (SELECT doc_id, md5(text) AS d FROM documents) SELECT r.doc_id, r.nth, r.pid FROM ring r JOIN m o ON o.doc_id = r.doc_id JOIN m p ON p.doc_id = r.pid LEFT JOIN holds h ON h.doc_id = r.doc_id AND h.pid = r.pid WHERE r.pid <> r.doc_id AND p.d <> o.d AND h.pid IS NULL")
def f07(spark, sf):
    seeds, filler = texts(spark, sf), pool(spark, sf)
    return R.around(seeds, filler)


@query("r07_bm25_filler")
def r07b(spark, sf):
    """Each document's nearest pool passages, topped up from the ring."""
    seeds, filler = texts(spark, sf), pool(spark, sf)
    return R.topped(L.neighbours(seeds, filler, many=True), seeds, filler)


@query("j16_containment", "WITH pool AS (SELECT doc_id AS pid, text FROM documents), " + HOLDS_SQL + ", c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class FROM documents) SELECT DISTINCT a.class AS seed_class, b.class AS doc_class FROM holds h JOIN c a ON a.doc_id = h.doc_id JOIN c b ON b.doc_id = h.pid WHERE a.class <> b.class")
def j16(spark, sf):
    """Documents that contain another one's whole text, as pairs of classes of equal texts, each named by its least id."""
    d = texts(spark, sf)
    least = d.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("class"))
    pairs = L.containing(d, d)
    named = pairs.join(least.select(F.col("digest").alias("own"), F.col("class").alias("seed_class")), "own")
    return named.join(least.select(F.col("digest").alias("holder"), F.col("class").alias("doc_class")), "holder").select("seed_class", "doc_class")


@query("p28_position_fractions", f"""SELECT doc_id, bin, round(lo + (hi - lo) * (({SEED.format(GLOBAL + "'random' || chr(31) || doc_id || chr(31) || bin")})::DOUBLE / 18446744073709551616.0), 6) AS frac FROM documents, (VALUES ('start', 0.0, 0.05), ('middle', 0.45, 0.55), ('end', 0.95, 1.0)) v(bin, lo, hi)""")
def p28(spark, sf):
    out = L.positions(texts(spark, sf).withColumn("is_gold", F.lit(True)), "random")
    return out.select("doc_id", F.col("position_bin").alias("bin"), F.round("position_frac", 6).alias("frac"))


@query("r08_weld_budgets", """WITH g AS (SELECT doc_id, length(text) AS n, 3700 AS b, (doc_id % 101) / 100.0 AS f FROM documents), s AS (SELECT *, b - n - 4 AS slack FROM g)
SELECT doc_id, slack >= 0 AS padded, CASE WHEN slack >= 0 THEN CAST(least(floor(f * slack), greatest(0, floor(0.97 * b) - n - 2)) AS BIGINT) END AS before, CASE WHEN slack >= 0 THEN CAST(slack - least(floor(f * slack), greatest(0, floor(0.97 * b) - n - 2)) AS BIGINT) END AS after FROM s""")
def r08(spark, sf):
    made = L.budgets(F.length("text"), F.lit(3700), (F.col("doc_id") % 101) / 100.0)
    return texts(spark, sf).select("doc_id", made.alias("w")).select("doc_id", "w.padded", "w.before", "w.after")


def built(spark, sf, condition="random", chosen="true", facts=()):
    """Welded documents of a condition at all rungs, and what they are made from."""
    j = C.qrels(spark, sf)
    golds = j.where("score > 0").select("doc_id").distinct().withColumn("is_gold", F.lit(True))
    seeds = texts(spark, sf).where(chosen).join(F.broadcast(golds), "doc_id", "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    filler = pool(spark, sf)
    if condition != "bm25":
        return R.welded(seeds, filler, condition, facts=facts), seeds, j
    tapes = L.tapes(L.chosen(seeds, filler, max(L.RUNGS), condition), filler)
    return L.ladder(seeds, tapes, condition), seeds, j


R09_SQL = """WITH """ + C.QRELS_SQL + """, g AS (SELECT DISTINCT doc_id FROM qrels WHERE score > 0), s AS (SELECT d.doc_id, length(text) AS n, md5(text) AS gold_md5, g.doc_id IS NOT NULL AS is_gold FROM documents d LEFT JOIN g USING (doc_id) WHERE {0})
SELECT CAST(s.doc_id AS VARCHAR) AS doc_id, CAST(r AS INT) AS rung_chars, bin AS position_bin, is_gold, n + 4 <= r AS padded, CAST(n AS INT) AS gold_chars, gold_md5 FROM s, (SELECT unnest([3700, 7400, 11800, 19000, 27000]) AS r), (SELECT unnest(['start', 'middle', 'end']) AS bin)
WHERE is_gold OR bin = ['start', 'middle', 'end'][CAST(""" + SEED.format("CAST(s.doc_id AS VARCHAR)") + """ % 3 AS INT) + 1]"""


def ladder_rows(welded):
    gold = F.substring("text", F.col("gold_char_start") + 1, F.col("gold_char_end") - F.col("gold_char_start"))
    return welded.select("doc_id", "rung_chars", "position_bin", "is_gold", "padded", (F.col("gold_char_end") - F.col("gold_char_start")).alias("gold_chars"), F.md5(gold).alias("gold_md5"))


@query("r09_welded_ladder", R09_SQL.format("true"))
def r09(spark, sf):
    return ladder_rows(built(spark, sf)[0])


@query("r09_welded_ladder_bm25", R09_SQL.format("d.doc_id % 20 = 0"))
def r09b(spark, sf):
    """The harder condition, of the documents whose ids are divisible by 20: each is a search over all of them."""
    return ladder_rows(built(spark, sf, "bm25", "doc_id % 20 = 0")[0])


@query("v15_verification_suite")
def v15(spark, sf):
    """All checks of one build; what they ask of each row is kept, not its text."""
    welded, seeds, j = built(spark, sf, facts=("gold_once", "nests", "fillers"))
    return V.suite(V.facts(welded).persist(), seeds, j)


@query("v08_constant_size", "SELECT 'corpus_size' AS \"check\", true AS ok, 0::BIGINT AS violations, '' AS detail")
def v08(spark, sf):
    return V.constant_size(built(spark, sf)[0])


@query("v01_gold_intact", "SELECT 'gold_intact' AS \"check\", true AS ok, 0::BIGINT AS violations, '' AS detail")
def v01(spark, sf):
    w, seeds, _ = built(spark, sf)
    return V.gold_intact(w, seeds)


@query("v11_filler_leakage", "SELECT 'filler_leakage' AS \"check\", true AS ok, 0::BIGINT AS violations, '' AS detail")
def v11(spark, sf):
    w, _, j = built(spark, sf, facts=("fillers",))
    return V.no_leaks(w, j)


@query("v10_answerable", "WITH " + C.QRELS_SQL + " SELECT 'answerable' AS \"check\", count(*) = 0 AS ok, count(*) AS violations, '' AS detail FROM (SELECT DISTINCT query_id FROM qrels WHERE score > 0 AND doc_id IN (SELECT doc_id FROM documents) EXCEPT SELECT query_id FROM qrels WHERE score > 0 AND doc_id % 3 > 0)")
def v10(spark, sf):
    d = texts(spark, sf)
    return V.answerable(d, d.where("doc_id % 3 > 0").select(F.col("doc_id").cast("string").alias("doc_id")), C.qrels(spark, sf))


@query("v09_same_ids", "SELECT 'ids' AS \"check\", false AS ok, count(*) AS violations, '' AS detail FROM documents WHERE doc_id % 7 = 0")
def v09(spark, sf):
    d = texts(spark, sf)
    return V.same_ids(d.where("doc_id % 7 > 0").select(F.col("doc_id").cast("string").alias("doc_id")), d)


@query("v13_token_headroom", "WITH t AS (SELECT " + WORDS.format("text") + " AS n FROM documents), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM t) SELECT 'token_headroom' AS \"check\", ((SELECT n FROM r WHERE i = floor(0.99 * c)) > 0.95 * 4096)::INT + (avg(CASE WHEN n > 4096 THEN 1.0 ELSE 0 END) > 0.01)::INT = 0 AS ok, ((SELECT n FROM r WHERE i = floor(0.99 * c)) > 0.95 * 4096)::BIGINT + (avg(CASE WHEN n > 4096 THEN 1.0 ELSE 0 END) > 0.01)::BIGINT AS violations, '' AS detail FROM t")
def v13(spark, sf):
    return V.headroom(texts(spark, sf).select(X.word_count(F.col("text")).alias("n_tokens")), 4096)


@query("v18_counts_match", "SELECT 'embeddings' AS \"check\", (SELECT count(*) FROM embeddings) = (SELECT count(*) FROM documents) AS ok, abs((SELECT count(*) FROM embeddings) - (SELECT count(*) FROM documents)) AS violations, '' AS detail")
def v18(spark, sf):
    return V.counts_match("embeddings", C.table(spark, sf, "embeddings"), texts(spark, sf))


@query("v20_golds_exist", "SELECT 'golds_exist' AS \"check\", count(*) = 0 AS ok, count(*) AS violations, '' AS detail FROM (SELECT DISTINCT doc_id FROM labels WHERE quality > 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0))")
def v20(spark, sf):
    j = C.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("score"))
    return V.golds_exist(j, texts(spark, sf).where("doc_id % 2 = 0"))


@query("r10_welded_training_set")
def r10(spark, sf):
    from quarry.operators import lexical

    d, q, j = texts(spark, sf), C.questions(spark, sf), C.qrels(spark, sf)
    triples = lexical.triples(q, d, j, lexical.hard_negatives(C.ranked(spark, sf, 50), j, 50, 3))
    out = L.training_set(triples, pool(spark, sf))
    return out.select("query_id", "rung_chars", "gold_char_start", "gold_char_end", F.size("hard_negs").alias("n_negs"), F.length("positive").alias("n_chars"))


def packed_sql(parts: str, most: int, joiner: str) -> str:
    """WITH up to packed(doc_id, nth, text, n): parts of an SQL list of texts joined greedily up to ``most`` tokens."""
    return f"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform({parts}, lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
p AS (SELECT doc_id, unnest(s) AS part, unnest(range(len(s))) AS i FROM l), z AS (SELECT *, {WORDS.format("part")} AS n FROM p),
w AS (SELECT doc_id, i, 0 AS nth, n AS size FROM z WHERE i = 0 UNION ALL
  SELECT z.doc_id, z.i, CASE WHEN w.size + z.n <= {most} THEN w.nth ELSE w.nth + 1 END, CASE WHEN w.size + z.n <= {most} THEN w.size + z.n ELSE z.n END FROM w JOIN z ON z.doc_id = w.doc_id AND z.i = w.i + 1),
packed AS (SELECT doc_id, CAST(nth AS BIGINT) AS nth, string_agg(part, {joiner} ORDER BY i) AS text, CAST(sum(n) AS BIGINT) AS n FROM w JOIN z USING (doc_id, i) GROUP BY doc_id, nth)
"""


SENTENCES_SQL = "regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query("w11_sentence_segments", packed_sql(SENTENCES_SQL, 64, "' '") + "SELECT doc_id, nth AS segment_id, md5(text) AS segment_md5, n AS n_tokens FROM packed")
def w11(spark, sf):
    out = E.segments(texts(spark, sf), 64)
    return out.select("doc_id", "segment_id", F.md5("segment_text").alias("segment_md5"), X.word_count(F.col("segment_text")).alias("n_tokens"))


@query("r27_segment_totals", "SELECT doc_id, CAST(" + WORDS.format("text") + " AS BIGINT) AS n_tokens FROM documents WHERE " + WORDS.format("text") + " > 0")
def r27(spark, sf):
    """Segmenting loses no token: sums over segments are the documents' own counts."""
    out = E.segments(texts(spark, sf), 64)
    return out.groupBy("doc_id").agg(F.sum(X.word_count(F.col("segment_text"))).alias("n_tokens"))


@query("w12_paragraph_windows", packed_sql("string_split(text, chr(10))", 128, "chr(10)") + "SELECT doc_id, nth AS window_idx, md5('passage: ' || text) AS window_md5 FROM packed")
def w12(spark, sf):
    out = L.paragraph_windows(texts(spark, sf), 130, prefix="passage: ")
    return out.select("doc_id", "window_idx", F.md5("window_text").alias("window_md5"))


@query("r13_fixed_windows", "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents), w AS (SELECT doc_id, t, unnest(generate_series(0, greatest(0, ceil((len(t) - 126) / 95))::BIGINT)) AS i FROM t) SELECT doc_id, i AS window_idx, md5('passage: ' || array_to_string(list_slice(t, i * 95 + 1, i * 95 + 126), ' ')) AS window_md5 FROM w")
def r13(spark, sf):
    out = L.fixed_windows(texts(spark, sf), 128, prefix="passage: ")
    return out.select("doc_id", "window_idx", F.md5("window_text").alias("window_md5"))


@query("r16_gold_visibility", "SELECT doc_id, " + WORDS.format("substr(text, 1, 200)") + " AS first_token, " + WORDS.format("substr(text, 1, 1200)") + " AS last_token, " + WORDS.format("substr(text, 1, 1200)") + " <= 200 AS visible FROM documents")
def r16(spark, sf):
    rows = texts(spark, sf).select("doc_id", "text", F.lit("x").alias("position_bin"), F.lit(0).alias("rung_chars"), F.lit(200).alias("gold_char_start"), F.lit(1200).alias("gold_char_end"))
    return L.visibility(rows, 200).select("doc_id", "first_token", "last_token", "visible")


# ---- enrichment -------------------------------------------------------------------------------------


def keyed(spark, sf):
    rows = texts(spark, sf).withColumn("translation", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("t"), F.col("doc_id").cast("string"))))
    return E.keyed(rows, "m", "p").withColumn("_id", F.col("doc_id"))


def cache(spark, sf):
    return E.keyed(texts(spark, sf).where("doc_id % 5 = 0"), "m", "p").groupBy("key").agg(F.concat(F.lit("c"), F.min("doc_id").cast("string")).alias("translation"))


FILL_SQL = """k AS (SELECT doc_id, sha256('m' || chr(0) || 'p' || chr(0) || text || chr(0)) AS key, CASE WHEN doc_id % 7 = 0 THEN 't' || doc_id END AS translation FROM documents),
c AS (SELECT key, 'c' || min(doc_id) AS cached FROM k WHERE doc_id % 5 = 0 GROUP BY key),
f AS (SELECT doc_id, key, coalesce(translation, cached) AS translation, CASE WHEN translation IS NOT NULL THEN 'own' WHEN cached IS NOT NULL THEN 'cache' WHEN row_number() OVER (PARTITION BY key ORDER BY doc_id) > 1 THEN 'twin' ELSE 'pending' END AS source FROM k LEFT JOIN c USING (key))"""


@query("r29_prefilled", "WITH " + FILL_SQL + " SELECT doc_id, translation, source FROM f")
def r29(spark, sf):
    return E.prefill(keyed(spark, sf), cache(spark, sf), "doc_id").select("doc_id", "translation", "source")


@query("j10_prefill_report", "WITH " + FILL_SQL + ", n AS (SELECT count(*) AS total, count(CASE WHEN source = 'own' THEN 1 END) AS own, count(CASE WHEN source = 'cache' THEN 1 END) AS \"cache\", count(CASE WHEN source = 'twin' THEN 1 END) AS twin, count(CASE WHEN source = 'pending' THEN 1 END) AS pending FROM f) SELECT *, twin + pending = 0 AS all_cached FROM n")
def j10(spark, sf):
    return E.prefill_report(E.prefill(keyed(spark, sf), cache(spark, sf), "doc_id"))


@query("w08_propagated", "WITH " + FILL_SQL + ", g AS (SELECT key, arg_min(translation, doc_id) FILTER (translation IS NOT NULL) AS first FROM f GROUP BY key) SELECT doc_id, coalesce(translation, first) AS translation FROM f LEFT JOIN g USING (key)")
def w08(spark, sf):
    return E.propagate(E.prefill(keyed(spark, sf), cache(spark, sf), "doc_id"), ["key"], "doc_id").select("doc_id", "translation")


@query("r30_cache_inserts", "WITH " + FILL_SQL + " SELECT key, arg_min(translation, doc_id) AS translation FROM f WHERE translation IS NOT NULL AND key NOT IN (SELECT key FROM c) GROUP BY key")
def r30(spark, sf):
    return E.to_insert(E.prefill(keyed(spark, sf), cache(spark, sf), "doc_id"), cache(spark, sf), "doc_id")


@query("x05_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'n' ELSE source END AS source FROM documents")
def x05(spark, sf):
    from quarry.operators.corpus import upsert

    old = C.docs(spark, sf).select("doc_id", "source")
    return upsert(old, old.where("doc_id % 3 = 0").withColumn("source", F.lit("n")), ["doc_id"], ["source"])


@query("x02_first_write_wins", "SELECT md5(text) AS key, arg_min(source, doc_id) AS value FROM documents GROUP BY md5(text)")
def x02(spark, sf):
    return C.docs(spark, sf).groupBy(F.md5("text").alias("key")).agg(F.min_by("source", "doc_id").alias("value"))


@query("x06_cache_lookup", "SELECT DISTINCT md5(text) AS key, 'hit' AS state FROM documents WHERE doc_id % 4 = 0 AND md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)")
def x06(spark, sf):
    d = C.docs(spark, sf)
    known = d.where("doc_id % 3 = 0").select(F.md5("text").alias("key"))
    return d.where("doc_id % 4 = 0").select(F.md5("text").alias("key")).distinct().join(known, "key", "left_semi").withColumn("state", F.lit("hit"))


@query("r26_defect_signals", """WITH t AS (SELECT doc_id, text AS en, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 300) ELSE text END AS he FROM documents),
n AS (SELECT *, list_distinct(regexp_extract_all(en, '\\d+(?:[.,]\\d+)?')) AS a, list_distinct(regexp_extract_all(he, '\\d+(?:[.,]\\d+)?')) AS b, length(regexp_replace(he, '[^A-Za-z]', '', 'g')) AS latin FROM t)
SELECT doc_id, round(length(he) / length(en), 6) AS len_ratio, CASE WHEN latin > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS latin_residue, round(CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6)::DOUBLE AS digit_jaccard, trim(he) = '' AS empty, length(he) AS he_chars, length(en) AS en_chars FROM n""")
def r26(spark, sf):
    m = F.col("doc_id") % 3
    rows = texts(spark, sf).withColumn("translation", F.when(m == 0, "").when(m == 1, F.substring("text", 1, 300)).otherwise(F.col("text")))
    out = E.defects(rows)
    return out.select("doc_id", F.round("len_ratio", 6).alias("len_ratio"), "latin_residue", F.round("digit_jaccard", 6).alias("digit_jaccard"), "empty", "he_chars", "en_chars")


@query("r28_grouped_contexts", f"SELECT md5(source) AS context_hash, source AS context, count(*) AS n_questions, arg_min(lang, {SEED.format(GLOBAL + 'doc_id')}) AS question FROM documents GROUP BY source")
def r28(spark, sf):
    rows = C.docs(spark, sf).select(F.col("source").alias("context"), F.col("lang").alias("question"), F.col("doc_id").alias("question_id"))
    return E.grouped_contexts(rows)


@query("r31_repaired", "SELECT doc_id, doc_id % 3 = 0 OR trim(text) = '' AS was_failed, trim(text) = '' AS still_failed FROM documents")
def r31(spark, sf):
    """Blank or short stand-in translations made again, all of them whole afterwards."""
    rows = texts(spark, sf).withColumn("translation", F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.upper("text")))
    out = E.repaired(rows, stubs.translate, lambda t: F.when(F.length(t) % 2 == 0, stubs.translate(t)).otherwise(F.lit("")))
    return out.select("doc_id", "was_failed", E.failed(F.col("text"), F.col("translation")).alias("still_failed"))


@query("r32_gate", """WITH s AS (SELECT l_linenumber - 1 AS score FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT l_linenumber - 1 AS score FROM lineitem WHERE l_returnflag = 'A'), a AS (SELECT avg(score) AS mean, stddev_samp(score) AS std, count(*) AS n FROM s), b AS (SELECT avg(score) AS pm, stddev_samp(score) AS ps FROM p)
SELECT round(mean, 6) AS mean, round(std, 6) AS std, n, round((pm - mean) / greatest(ps, 0.5), 6) AS z, (pm - mean) / greatest(ps, 0.5) <= 1.5 AND mean >= 2.5 AS passed FROM a, b""")
def r32(spark, sf):
    t = C.judged_scores(spark, sf)
    out = E.gate(t.where("judge = 'R'"), t.where("judge = 'A'"))
    return out.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n", F.round("z", 6).alias("z"), "passed")


@query("r33_titles_once", "SELECT doc_id, upper(source) AS title_translation FROM documents")
def r33(spark, sf):
    return E.unique_titles(C.docs(spark, sf).select("doc_id", F.col("source").alias("title")), stubs.translate).select("doc_id", "title_translation")


@query("k08_mirror", "SELECT doc_id, md5(coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN lang ELSE ' ' END), ''), text)) AS text_md5, nullif(trim(CASE WHEN doc_id % 2 = 0 THEN lang ELSE ' ' END), '') IS NULL AS fallback FROM documents")
def k08(spark, sf):
    rows = texts(spark, sf).join(C.docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" ").alias("text_en")), "doc_id")
    return E.mirrored(rows).select("doc_id", F.md5("text").alias("text_md5"), "fallback")


@query("e01_tokenizers", "SELECT doc_id, " + WORDS.format("text") + " AS whitespace, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS unicode FROM documents")
def e01(spark, sf):
    return texts(spark, sf).select("doc_id", *(F.size(stubs.tokenizer(n)(F.col("text"))).cast("long").alias(n) for n in ("whitespace", "unicode")))


@query("e02_encoder_stub")
def e02(spark, sf):
    return texts(spark, sf).select("doc_id", F.transform(stubs.encode(F.col("text"), 8), lambda x: F.round(x, 6)).alias("embedding"))


@query("e05_judge_stub", "WITH t AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 1, length(text) // 4) END AS t FROM documents) SELECT doc_id, CASE WHEN trim(t) = '' THEN 0 WHEN length(t) / length(text) < 0.5 THEN 2 ELSE 5 END AS score FROM t")
def e05(spark, sf):
    t = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.substring("text", F.lit(1), F.floor(F.length("text") / 4).cast("int")))
    return texts(spark, sf).select("doc_id", stubs.judge(F.col("text"), t)["score"].alias("score"))


@query("e06_checked_verdicts", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS key_term_lost, o_orderkey % 3 = 0 AS error FROM orders")
def e06(spark, sf):
    good = F.concat(F.lit('{"key_term_lost": '), (F.col("o_orderkey") % 2 == 0).cast("string"), F.lit(', "retrieval_risk": "low"}'))
    v = parsers.checked_verdict(F.when(F.col("o_orderkey") % 3 == 0, F.lit("{bad")).otherwise(good))
    return C.table(spark, sf, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", "v.key_term_lost", "v.error")


@query("p14_sentences", "SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS n FROM documents")
def p14(spark, sf):
    return texts(spark, sf).select("doc_id", F.size(parsers.sentences(F.col("text"))).cast("long").alias("n"))


@query("p17_pages")
def p17(spark, sf):
    rows = C.table(spark, sf, "pages").select("page_id", parsers.page(F.col("html")).alias("p"))
    return rows.select("page_id", "p.title", F.md5("p.text").alias("text_md5"), F.size("p.sections").alias("n_sections"))


@query("p16_articles", "SELECT doc_id, lang AS title, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INT) AS n_abstract, source AS positive FROM documents")
def p16(spark, sf):
    marked = F.concat(F.lit(parsers.ARTICLE + "\n"), "lang", F.lit("\n" + parsers.PARAGRAPH + "\n"), F.replace("text", F.lit("\n"), F.lit(parsers.NEWLINE)), F.lit("\n" + parsers.SECTION + "\nx\n" + parsers.PARAGRAPH + "\n"), "source")
    rows = C.docs(spark, sf).select("doc_id", parsers.article(marked).alias("a"))
    return rows.select("doc_id", "a.title", F.size("a.abstract").alias("n_abstract"), parsers.article_pair(F.col("a"))["positive"].alias("positive"))


@query("i03_first_seen_across_shards", "SELECT md5(text) AS key, min(doc_id // 100) AS shard FROM documents GROUP BY md5(text)")
def i03(spark, sf):
    return C.docs(spark, sf).groupBy(F.md5("text").alias("key")).agg(F.min(F.floor(F.col("doc_id") / 100)).alias("shard"))


@query("i01_ladder_steps", "SELECT CAST(floor(log2(s + 1) + 1e-9) AS BIGINT) AS step, count(DISTINCT s) AS shards, count(*) AS rows, sum(count(*)) OVER (ORDER BY CAST(floor(log2(s + 1) + 1e-9) AS BIGINT))::BIGINT AS upto FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS s FROM documents) GROUP BY 1")
def i01(spark, sf):
    from quarry.operators.corpus import cadence, shards

    rows = shards(C.docs(spark, sf).select("doc_id"), 50, ["doc_id"])
    steps = rows.groupBy(cadence(F.col("shard"), "exponential").alias("step")).agg(F.countDistinct("shard").alias("shards"), F.count("*").alias("rows"))
    return steps.withColumn("upto", F.sum("rows").over(Window.orderBy("step")))
