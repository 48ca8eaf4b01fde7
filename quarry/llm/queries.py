"""The queries of this package's operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .common import table
from .lang_id import identify
from .licenses import license_rows
from .near_dup import near_dup
from .packing import packed_digests
from .pieces import round_trip_rows
from .quality import quality_rows
from .repeats import digest_rows
from .secret_scan import secret_rows
from .sketches import edited_fingerprints
from .url_filter import filter_urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles as the contract has it; the operator's own default is five."""
    return near_dup(table(spark, sf_dir, "documents"), size=2)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_rows(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rows(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_rows(table(spark, sf_dir, "documents"), width=100)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ranges of ids for each shuffle partition, so that partitions come out even."""
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return edited_fingerprints(table(spark, sf_dir, "documents"), parts)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_rows(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_minhash_near_dedup,
        op3_quality_rules,
        op4_secret_scan,
        op5_language_id,
        op6_license_scan,
        op7_url_filter,
        op8_suffix_array_dedup,
        op9_document_fingerprints,
        op10_sentencepiece,
        pipeline,
    )
}
#: Components by a recursive walk over all links, and windows one by one. The other queries need a
#: tokenizer, a trained model, free numbers or hashes of Spark's own; tests hold them against brute force.
SQL: dict[str, str] = {
    "op2_minhash_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(t) = 1 THEN t[1] ELSE t[i] || ' ' || t[i + 1] END AS g FROM (SELECT doc_id, t, unnest(generate_series(1, greatest(len(t) - 1, least(len(t), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id, coalesce(least, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id
""",
    "op8_suffix_array_dedup": """
WITH b AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS p FROM b)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS nth FROM w),
r AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM f WHERE nth > 1),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM r),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM i GROUP BY doc_id, island),
k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM s),
g AS (SELECT b.doc_id, CAST(sum(k.z - k.a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN after IS NULL THEN substr(h, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS kept FROM k JOIN b USING (doc_id) GROUP BY b.doc_id)
SELECT b.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN g USING (doc_id)
""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
