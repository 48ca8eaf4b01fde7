"""Queries of lexical and dense retrieval, hard negatives and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import dense, lexical, metrics
from quarry.plans import common as C
from quarry.plans.registry import query


def rounded(df, *names, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


@query("a11_index_statistics", "WITH " + C.POSTINGS_SQL.format(min_df=2) + "\nSELECT n AS n_docs, (SELECT count(*) FROM raw) AS n_terms, (SELECT count(*) FROM kept) AS n_postings, round((SELECT mean_length FROM mean), 6) AS mean_length, round((SELECT avg(raw) FROM raw), 6) AS mean_idf FROM tot")
def a11(spark, sf):
    return rounded(lexical.statistics(C.docs(spark, sf)), "mean_length", "mean_idf")


@query("r01_bm25_postings", "WITH " + C.POSTINGS_SQL.format(min_df=2) + "\nSELECT doc_id, term, tf, df, round(weight, 6) AS weight FROM post")
def r01(spark, sf):
    return rounded(lexical.postings(C.docs(spark, sf)), "weight")


@query("r02_bm25_topk", C.bm25_sql(10) + "\nSELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked")
def r02(spark, sf):
    return rounded(C.ranked(spark, sf), "score")


@query("p01_script_tokens", "SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '[\\x{0591}-\\x{05C7}]', '', 'g'), '[\\x{05F3}\\x{05F4}''\"]', '', 'g'), '[\\x{05D0}-\\x{05EA}]+|[A-Za-z]+|\\p{Nd}+'), lambda x: lower(x)) AS t FROM documents)")
def p01(spark, sf):
    from quarry.functions.text import script_tokens

    t = C.docs(spark, sf).select("doc_id", script_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("j13_sparse_inner_product", C.bm25_sql(10) + "\nSELECT query_id, count(*) AS n_docs, round(sum(score), 4) AS total FROM scored GROUP BY query_id")
def j13(spark, sf):
    s = lexical.scores(lexical.postings(C.docs(spark, sf)), C.questions(spark, sf))
    return s.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.round(F.sum("score"), 4).alias("total"))


@query("l01_topk_banned", "WITH " + C.POSTINGS_SQL.format(min_df=2) + ",\n" + C.SCORED_SQL.format(k=10) + ",\n" + C.QRELS_SQL + "\nSELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored s WHERE NOT EXISTS (SELECT 1 FROM qrels q WHERE q.query_id = s.query_id AND q.doc_id = s.doc_id) QUALIFY rank <= 10")
def l01(spark, sf):
    return rounded(lexical.search(C.docs(spark, sf).select("doc_id", "text"), C.questions(spark, sf), 10, banned=C.qrels(spark, sf)), "score")


@query("d01_qrels", "WITH " + C.QRELS_SQL + "\nSELECT query_id, doc_id, CAST(score AS INT) AS score FROM qrels")
def d01(spark, sf):
    return C.qrels(spark, sf)


NEG_SQL = C.bm25_sql(100) + ",\n" + C.QRELS_SQL + """,
neg AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM ranked r
  WHERE NOT EXISTS (SELECT 1 FROM qrels q WHERE q.score > 0 AND q.query_id = r.query_id AND q.doc_id = r.doc_id) QUALIFY nth <= 5)"""


@query("l03_first_non_positives", NEG_SQL + "\nSELECT query_id, doc_id, nth FROM neg")
def l03(spark, sf):
    return lexical.hard_negatives(C.ranked(spark, sf, 100), C.qrels(spark, sf))


@query("r03_hard_negative_triples", NEG_SQL + "\n, listed AS (SELECT n.query_id, list(d.text ORDER BY n.nth) AS t FROM neg n JOIN documents d USING (doc_id) GROUP BY n.query_id)\nSELECT q.query_id, q.doc_id AS positive_id, b.text AS query, md5(d.text) AS positive_md5, md5(array_to_string(t, '|')) AS negs_md5, CAST(len(t) AS BIGINT) AS n_negs FROM qrels q JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = q.query_id JOIN listed l ON l.query_id = q.query_id WHERE q.score > 0")
def r03(spark, sf):
    d, q, j = C.docs(spark, sf), C.questions(spark, sf), C.qrels(spark, sf)
    rows = lexical.triples(q, d, j, lexical.hard_negatives(C.ranked(spark, sf, 100), j))
    return rows.select("query_id", "positive_id", "query", F.md5("positive").alias("positive_md5"), F.md5(F.array_join("hard_negs", "|")).alias("negs_md5"), F.size("hard_negs").cast("long").alias("n_negs"))


@query("t14_widened_negatives", NEG_SQL + "\nSELECT query_id, " + ", ".join(f"coalesce(max(CASE WHEN nth = {i + 1} THEN CAST(doc_id AS VARCHAR) END), '') AS hard_neg_{i}" for i in range(7)) + " FROM neg GROUP BY query_id")
def t14(spark, sf):
    n = lexical.hard_negatives(C.ranked(spark, sf, 100), C.qrels(spark, sf))
    rows = n.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col("doc_id").cast("string").alias("d")))), lambda s: s["d"]).alias("hard_negs"))
    return lexical.widen(rows, 7)


@query("j01_training_pairs", "WITH " + C.QRELS_SQL + "\nSELECT query_id, doc_id, b.text AS query, md5(d.text) AS positive_md5, q.score FROM qrels q JOIN benchmark b ON b.item_id = q.query_id JOIN documents d USING (doc_id) WHERE q.score > 0")
def j01(spark, sf):
    rows = C.qrels(spark, sf).where("score > 0").join(C.questions(spark, sf).withColumnRenamed("text", "query"), "query_id").join(C.docs(spark, sf).select("doc_id", "text"), "doc_id")
    return rows.select("query_id", "doc_id", "query", F.md5("text").alias("positive_md5"), "score")


JUDGE_SQL = C.bm25_sql(100) + ",\n" + C.QRELS_SQL + """,
jud AS (SELECT q.query_id, q.doc_id, q.score, r.rank FROM qrels q LEFT JOIN ranked r ON r.query_id = q.query_id AND r.doc_id = q.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS nth FROM qrels),
ideal AS (SELECT query_id, sum(CASE WHEN nth <= 10 THEN score / log2(nth + 1) ELSE 0 END) AS i10, sum(CASE WHEN nth <= 100 THEN score / log2(nth + 1) ELSE 0 END) AS i100 FROM best GROUP BY query_id),
per AS (SELECT j.query_id, count(CASE WHEN score > 0 THEN 1 END) AS n_relevant, min(CASE WHEN score > 0 THEN rank END) AS first_rank,
  count(CASE WHEN score > 0 AND rank <= 1 THEN 1 END) AS c1, count(CASE WHEN score > 0 AND rank <= 5 THEN 1 END) AS c5, count(CASE WHEN score > 0 AND rank <= 10 THEN 1 END) AS c10, count(CASE WHEN score > 0 AND rank <= 100 THEN 1 END) AS c100,
  sum(CASE WHEN rank <= 10 THEN score / log2(rank + 1) ELSE 0 END) AS d10, sum(CASE WHEN rank <= 100 THEN score / log2(rank + 1) ELSE 0 END) AS d100 FROM jud j GROUP BY j.query_id),
m AS (SELECT p.query_id, n_relevant, first_rank, CASE WHEN first_rank = 1 THEN 1.0 ELSE 0.0 END AS success_1, coalesce(1.0 / first_rank, 0.0) AS mrr, CASE WHEN first_rank <= 10 THEN 1.0 / first_rank ELSE 0.0 END AS mrr_10,
  CASE WHEN first_rank IS NULL THEN 0.0 ELSE 1.0 END AS hit, c1 / greatest(n_relevant, 1) AS recall_1, c5 / greatest(n_relevant, 1) AS recall_5, c10 / greatest(n_relevant, 1) AS recall_10, c100 / greatest(n_relevant, 1) AS recall_100,
  c1 / 1 AS precision_1, c5 / 5 AS precision_5, c10 / 10 AS precision_10, c100 / 100 AS precision_100,
  CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0 END AS ndcg_10, CASE WHEN i100 > 0 THEN d100 / i100 ELSE 0 END AS ndcg_100 FROM per p JOIN ideal USING (query_id))"""
NAMES = ["success_1", "mrr", "mrr_10", "hit", "recall_1", "recall_5", "recall_10", "recall_100", "ndcg_10", "ndcg_100"]


def measures(spark, sf):
    return metrics.per_query(C.ranked(spark, sf, 100), C.qrels(spark, sf))


@query("r17_retrieval_metrics", JUDGE_SQL + "\nSELECT count(*) AS n, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in NAMES) + " FROM m")
def r17(spark, sf):
    return measures(spark, sf).agg(F.count("*").alias("n"), *(F.round(F.avg(n), 6).alias(n) for n in NAMES))


@query("r18_per_query_metrics", JUDGE_SQL + "\nSELECT query_id, n_relevant, " + ", ".join(f"round({n}, 6) AS {n}" for n in NAMES) + " FROM m")
def r18(spark, sf):
    return measures(spark, sf).select("query_id", "n_relevant", *(F.round(n, 6).alias(n) for n in NAMES))


@query("r21_precision", JUDGE_SQL + "\nSELECT round(avg(precision_1), 6) AS precision_1, round(avg(precision_5), 6) AS precision_5, round(avg(precision_10), 6) AS precision_10, round(avg(precision_100), 6) AS precision_100 FROM m")
def r21(spark, sf):
    return measures(spark, sf).agg(*(F.round(F.avg(f"precision_{k}"), 6).alias(f"precision_{k}") for k in (1, 5, 10, 100)))


@query("w02_first_relevant_rank", JUDGE_SQL + "\nSELECT query_id, n_relevant, first_rank FROM m")
def w02(spark, sf):
    return metrics.first_rank(C.ranked(spark, sf, 100), C.qrels(spark, sf))


@query("r19_full_ranking_hits", JUDGE_SQL + "\nSELECT round(avg(success_1), 6) AS accuracy_1, round(avg(mrr), 6) AS mrr, round(avg(CASE WHEN c5 > 0 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN c10 > 0 THEN 1.0 ELSE 0 END), 6) AS hit_10, round(avg(CASE WHEN c100 > 0 THEN 1.0 ELSE 0 END), 6) AS hit_100 FROM m JOIN per USING (query_id)")
def r19(spark, sf):
    return measures(spark, sf).agg(F.round(F.avg("success_1"), 6).alias("accuracy_1"), F.round(F.avg("mrr"), 6).alias("mrr"), *(F.round(F.avg(f"hit_{k}"), 6).alias(f"hit_{k}") for k in (5, 10, 100)))


@query("r20_single_gold", C.bm25_sql(100) + ",\n" + C.QRELS_SQL + """,
gold AS (SELECT query_id, doc_id FROM qrels WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1)
SELECT count(*) AS n, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6) AS accuracy_1, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10
FROM gold g LEFT JOIN ranked r USING (query_id, doc_id)""")
def r20(spark, sf):
    best = C.qrels(spark, sf).where("score > 0").groupBy("query_id").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id"))
    rows = best.join(C.ranked(spark, sf, 100), ["query_id", "doc_id"], "left")
    at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return rows.agg(F.count("*").alias("n"), at(1).alias("accuracy_1"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), at(5).alias("recall_5"), at(10).alias("recall_10"))


@query("r22_bm25_control", JUDGE_SQL + "\nSELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half, count(*) AS n, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(mrr_10), 6) AS mrr_10 FROM m GROUP BY 1")
def r22(spark, sf):
    return measures(spark, sf).groupBy(F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("half")).agg(F.count("*").alias("n"), F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"), F.round(F.avg("mrr_10"), 6).alias("mrr_10"))


@query("a13_metrics_by_bin", JUDGE_SQL + """, b AS (SELECT m.*, ['start', 'middle', 'end'][CAST(query_id % 3 AS INT) + 1] AS bin, query_id % 2 = 0 AS visible FROM m)
SELECT bin, visible, count(*) AS n, round(avg(mrr_10), 6) AS mrr_10, round(avg(ndcg_10), 6) AS ndcg_10 FROM b GROUP BY GROUPING SETS ((bin), (visible), ())""")
def a13(spark, sf):
    rows = measures(spark, sf).withColumn("bin", F.element_at(F.array(*map(F.lit, ("start", "middle", "end"))), (F.col("query_id") % 3 + 1).cast("int"))).withColumn("visible", F.col("query_id") % 2 == 0)
    return rounded(metrics.by_bin(rows, ["mrr_10", "ndcg_10"], "bin", "visible"), "mrr_10", "ndcg_10")


CLUSTER_SQL = JUDGE_SQL + ", cl AS (SELECT query_id, min(CAST(doc_id AS VARCHAR)) AS cluster FROM qrels WHERE score > 0 GROUP BY query_id)"
BOOT_SQL = """, cs AS (SELECT cluster, sum({v}) AS total, count({v}) AS n, row_number() OVER (ORDER BY cluster) - 1 AS nth FROM {src} GROUP BY cluster),
sz AS (SELECT count(*) AS clusters FROM cs),
dr AS (SELECT r.range AS round, unnest(generate_series(1, clusters)) AS draw, clusters FROM range(200) r, sz),
pk AS (SELECT round, CAST(('0x' || substr(sha256('0' || chr(31) || round || chr(31) || draw), 1, 16))::UBIGINT % clusters AS BIGINT) AS nth FROM dr),
mn AS (SELECT round, sum(total) / sum(n) AS mean FROM pk JOIN cs USING (nth) GROUP BY round),
pl AS (SELECT mean, row_number() OVER (ORDER BY mean, round) - 1 AS place FROM mn)
SELECT round((SELECT sum(total) / sum(n) FROM cs), 6) AS mean, clusters, round((SELECT mean FROM pl WHERE place = 5), 6) AS low, round((SELECT mean FROM pl WHERE place = 195), 6) AS high FROM sz"""


@query("a14_cluster_bootstrap", CLUSTER_SQL + ", src AS (SELECT cluster, mrr_10 FROM m JOIN cl USING (query_id))" + BOOT_SQL.format(v="mrr_10", src="src"))
def a14(spark, sf):
    rows = measures(spark, sf).join(metrics.cluster_of(C.qrels(spark, sf)), "query_id").select("cluster", "mrr_10")
    return rounded(metrics.bootstrap(rows, "mrr_10", rounds=200), "mean", "low", "high")


@query("a15_paired_bootstrap", CLUSTER_SQL + ", src AS (SELECT cluster, recall_10 - recall_1 AS gain FROM m JOIN cl USING (query_id))" + BOOT_SQL.format(v="gain", src="src"))
def a15(spark, sf):
    rows = measures(spark, sf).join(metrics.cluster_of(C.qrels(spark, sf)), "query_id")
    a, b = (rows.select("query_id", "cluster", F.col(c).alias("gain")) for c in ("recall_1", "recall_10"))
    return rounded(metrics.paired_bootstrap(a, b, "gain", rounds=200), "mean", "low", "high")


@query("v21_bm25_self_test")
def v21(spark, sf):
    """The script tokenizer's ranking against the word tokenizer's."""
    from quarry.functions.text import script_tokens

    d, q = C.docs(spark, sf).select("doc_id", "text"), C.questions(spark, sf)
    return rounded(lexical.compare(lexical.search(d, q, 10), lexical.search(d, q, 10, tokenizer=script_tokens)), "overlap", "max_abs_diff", "mean_rank_corr")


DOT_SQL = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
KNN_SQL = f"""WITH pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({DOT_SQL}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs WHERE query_id <> doc_id QUALIFY rank <= 10)"""


def vectors(spark, sf):
    e = C.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return e, e.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")


@query("j14_dense_knn", KNN_SQL.replace("WHERE query_id <> doc_id ", "") + "\nSELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked")
def j14(spark, sf):
    e, q = vectors(spark, sf)
    return rounded(dense.knn(q, e, 10), "score")


@query("w03_dense_without_self", KNN_SQL + "\nSELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked")
def w03(spark, sf):
    e, q = vectors(spark, sf)
    return rounded(metrics.without_self(dense.knn(q, e, 11), 10).select("query_id", "doc_id", "score", "rank"), "score")


@query("j15_self_neighbours", KNN_SQL.replace("a.vec_id % 20 = 0", "true").replace("rank <= 10", "rank <= 3") + "\nSELECT query_id, doc_id, rank FROM ranked")
def j15(spark, sf):
    e, _ = vectors(spark, sf)
    return dense.knn(e.withColumnRenamed("doc_id", "query_id"), e, 3, exclude_self=True).select("query_id", "doc_id", "rank")


@query("u07_id_overlap", "SELECT round(count(CASE WHEN doc_id IS NOT NULL THEN 1 END) / count(*), 6) AS overlap, count(CASE WHEN doc_id IS NOT NULL THEN 1 END) / count(*) > 0.5 AS exclude_self FROM benchmark LEFT JOIN documents ON item_id = doc_id")
def u07(spark, sf):
    return rounded(metrics.id_overlap(C.questions(spark, sf), C.docs(spark, sf)), "overlap")


@query("r04_dense_metrics", KNN_SQL + """, rel AS (SELECT r.*, a.label = b.label AS hit FROM ranked r JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id),
per AS (SELECT query_id, min(CASE WHEN hit THEN rank END) AS f, count(CASE WHEN hit THEN 1 END) AS c FROM rel GROUP BY query_id)
SELECT count(*) AS n, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr_10, round(avg(c / 10), 6) AS precision_10 FROM per""")
def r04(spark, sf):
    e, q = vectors(spark, sf)
    labels = e.select("doc_id", "label")
    near = dense.knn(q, e, 10, exclude_self=True).join(labels, "doc_id").join(labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    per = near.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("own"), F.col("rank"))).alias("f"), F.count_if(F.col("label") == F.col("own")).alias("c"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1.0 / F.col("f"), F.lit(0.0))), 6).alias("mrr_10"), F.round(F.avg(F.col("c") / 10), 6).alias("precision_10"))


@query("r12_patched_documents", KNN_SQL.replace("a.vec_id % 20 = 0", "true").replace("rank <= 10", "rank <= 2") + """, near AS (SELECT r.query_id, list(d.text ORDER BY rank) AS t, list(r.doc_id ORDER BY rank) AS ids FROM ranked r JOIN documents d ON d.doc_id = r.doc_id GROUP BY r.query_id)
SELECT d.doc_id, md5(d.text || chr(10) || chr(10) || '---' || chr(10) || chr(10) || array_to_string(t, chr(10) || chr(10) || '---' || chr(10) || chr(10))) AS text_md5, array_to_string(ids, ',') AS neighbours FROM near JOIN documents d ON d.doc_id = query_id""")
def r12(spark, sf):
    e, _ = vectors(spark, sf)
    rows = dense.patched(C.docs(spark, sf).select("doc_id", "text"), e.select("doc_id", "embedding"), 2)
    return rows.select("doc_id", F.md5("text").alias("text_md5"), F.array_join("neighbours", ",").alias("neighbours"))


@query("r36_similarity_diagonal", f"WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({DOT_SQL}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p) SELECT query_id, rank FROM r WHERE query_id = doc_id")
def r36(spark, sf):
    e, _ = vectors(spark, sf)
    few = e.where("doc_id % 20 = 0")
    return metrics.diagonal(dense.similarities(few.withColumnRenamed("doc_id", "query_id"), few).withColumn("score", F.round("score", 9)))


@query("r37_without_components")
def r37(spark, sf):
    e, _ = vectors(spark, sf)
    out = dense.without_components(e, dense.principal_components(e, 2))
    return out.select("doc_id", "label", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))


@query("a36_pooled_windows", "WITH w AS (SELECT l_suppkey % 50 AS query_id, l_partkey % 200 AS doc_id, l_discount AS score FROM lineitem) SELECT query_id, doc_id, max(score) AS score FROM w GROUP BY query_id, doc_id")
def a36(spark, sf):
    rows = C.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("query_id"), (F.col("l_partkey") % 200).alias("doc_id"), F.col("l_discount").alias("score"))
    return metrics.pool_windows(rows)


@query("a40_set_measures", """WITH t AS (SELECT DISTINCT l_orderkey % 500 AS row_id, l_suppkey AS item FROM lineitem WHERE l_returnflag = 'R'),
p AS (SELECT l_orderkey % 500 AS row_id, l_suppkey AS item, round(sum(l_quantity), 2) AS score FROM lineitem GROUP BY 1, 2),
k AS (SELECT row_id, count(*) AS k FROM t GROUP BY row_id), x AS (SELECT p.row_id, p.item FROM p JOIN k USING (row_id) QUALIFY row_number() OVER (PARTITION BY p.row_id ORDER BY score DESC, item) <= max(k) OVER (PARTITION BY p.row_id)),
c AS (SELECT (SELECT count(*) FROM x JOIN t USING (row_id, item)) AS tp, (SELECT count(*) FROM x) AS np, (SELECT count(*) FROM t) AS nt) SELECT round(tp / np, 6) AS precision, round(tp / nt, 6) AS recall, round(2 * tp / (np + nt), 6) AS f1 FROM c""")
def a40(spark, sf):
    lines = C.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("row_id"), F.col("l_suppkey").alias("item"), "l_quantity", "l_returnflag")
    scored = lines.groupBy("row_id", "item").agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    return rounded(metrics.set_measures(scored, lines.where("l_returnflag = 'R'").select("row_id", "item")), "precision", "recall", "f1")


@query("r25_two_rankings", JUDGE_SQL + "\nSELECT query_id, n_relevant, first_rank AS rank_a, first_rank AS rank_b, coalesce(first_rank <= 10, false) AS hit_a, round(mrr, 6) AS rr_a FROM m WHERE n_relevant > 0")
def r25(spark, sf):
    """Ranks of two rankings side by side; here one ranking twice, by two plans."""
    j = C.qrels(spark, sf)
    a, b = (metrics.first_rank(C.ranked(spark, sf, 100), j) for _ in range(2))
    both = a.where("n_relevant > 0").join(b.select("query_id", F.col("first_rank").alias("rank_b")), "query_id")
    return both.select("query_id", "n_relevant", F.col("first_rank").alias("rank_a"), "rank_b", F.coalesce(F.col("first_rank") <= 10, F.lit(False)).alias("hit_a"), F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("rr_a"))


@query("r24_rescored", JUDGE_SQL + ", o AS (SELECT avg(mrr) AS mrr, avg(ndcg_10) AS ndcg_10 FROM m), l AS (SELECT 'mrr' AS measure, mrr AS v FROM o UNION ALL SELECT 'ndcg_10', ndcg_10 FROM o) SELECT 'bm25' AS key, measure, round(v, 6) AS old, round(v + (CASE WHEN measure = 'mrr' THEN 0.01 ELSE 0 END), 6) AS new, round(CASE WHEN measure = 'mrr' THEN 0.01 ELSE 0 END, 6) AS delta, measure <> 'mrr' AS agrees FROM l")
def r24(spark, sf):
    old = measures(spark, sf).agg(F.avg("mrr").alias("mrr"), F.avg("ndcg_10").alias("ndcg_10")).withColumn("key", F.lit("bm25"))
    return rounded(metrics.rescored(old, old.withColumn("mrr", F.col("mrr") + 0.01), ["mrr", "ndcg_10"]), "old", "new", "delta")
