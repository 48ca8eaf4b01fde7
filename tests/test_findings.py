"""Faults of earlier versions, one small test each."""

from pyspark.sql import functions as F

from quarry.functions import parsers as P
from quarry.functions import stubs
from quarry.functions import text as X
from quarry.operators import bulk, lexical
from quarry.operators import enrichment as E
from quarry.operators import longctx as L
from quarry.operators import rings as R
from quarry.operators import verify as V


def test_parts_lose_no_digits_of_their_index(spark):
    """The part at index 1 kept its ones, and the spaces around it went."""
    rows = spark.createDataFrame([(1, " Zero. 19.37.233.111 1! 2 and 22"), (2, "0\n 11 1 \n2")], "doc_id long, text string")
    got = {r.doc_id: (r.s, r.p) for r in rows.select("doc_id", P.sentences(F.col("text")).alias("s"), X.paragraphs(F.col("text")).alias("p")).collect()}
    assert got[1][0] == ["Zero.", "19.37.233.111 1!", "2 and 22"] and got[2][1] == ["0", "11 1", "2"]
    assert [r.segment_text for r in E.segments(rows.where("doc_id = 1"), 64).collect()] == ["Zero. 19.37.233.111 1! 2 and 22"]
    assert [r.window_text for r in L.paragraph_windows(rows.where("doc_id = 2"), 130).collect()] == ["0\n11 1\n2"]


def test_encoder_parts_a_text_into_tokens_once(spark):
    """The tokens stood in lambdas, and were made again for each dimension and use."""
    made = spark.createDataFrame([(1, "a b b c"), (2, ""), (3, None)], "doc_id long, text string").select("doc_id", stubs.encode(F.col("text"), 4).alias("v"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = {r.doc_id: r.v for r in made.collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-12 and got[2] == [0.0] * 4 and got[3] == [None] * 4


def test_fillers_are_chosen_and_joined_where_their_texts_are(spark):
    """Fillers moved as rows of ids, and then with their texts, once for each document: far more than the input."""
    sizes = [40, 3000, 120, 700, 60, 90]
    made = [(i, f"p{i} first second third {'x' * 70}{i} " + "yé" * ((sizes[i % 6] + i) // 2)) for i in range(300)]
    made += [(300 + i, f"in {made[i][1]} out") for i in range(0, 60, 3)] + [(400, made[0][1]), (404, "two words"), (408, ""), (412, None)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    seeds, pool = d.where("doc_id % 4 = 0").withColumn("is_gold", F.col("doc_id") % 8 == 0), d.where("length(text) > 9").select(F.col("doc_id").alias("pid"), "text")
    key = lambda rows: sorted(map(tuple, rows), key=str)
    for top, k, rows in ((4000, 50, 50), (90_000, 50, 400)):
        want = L.without_own(L.ring(seeds, pool, k), seeds, pool).select("doc_id", "nth", "pid").collect()
        assert key(R.around(seeds, pool, k, rows=rows).collect()) == key(want) and want
        tapes = L.tapes(L.dealt(L.without_own(L.drawn(seeds, pool, "random", k), seeds, pool, 2 * top), top), pool)
        want = L.ladder(seeds, tapes, "random", (300, 1500, top))
        got = R.welded(seeds, pool, "random", (300, 1500, top), k, ("gold_once", "nests"), rows=rows)
        assert got.columns[:-2] == want.columns and key(got.drop("gold_once", "nests").collect()) == key(want.collect())
        assert [r.violations for r in (V.nested(got).first(), V.nested(want).first())] == [0, 0]
        assert V.gold_once(got, seeds).first() == V.gold_once(want, seeds).first() and V.gold_intact(got, seeds).first().violations == 3  # the null
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 4


def test_judgements_move_no_text(spark):
    """Documents' texts were shuffled by id to meet the queries they might contain."""
    from quarry.plans import common as C

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.qrels(spark, "/root/testdata/sf0.001").where("score > 0")
        parts = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [p for p in parts if ") Exchange\n" in p]
    assert moved and not [p for p in moved if "text#" in p.split("Arguments")[0]]
    assert found.count() > 0


def test_op4_tags_every_token(spark):
    """Tokens of letters only, up to 23 bytes and without a cue before them, were never tagged."""
    import numpy as np
    from quarry.llm import secret_scan as S

    field, rng = S.Field(), np.random.default_rng(3)
    field.emit[:] = rng.normal(0, 0.3, field.emit.shape).astype(np.float32)
    field.emit[:, 2] += 0.06
    field.move, field.start = rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    texts = [" ".join(line) for line, _ in S._lines(seed=9)[:150]] + ["short", "", " a  ", "key: Zq", "İé ñandú=x :: = ab:c y", "words of letters " * 40, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, model, least in (("any", field, 16), ("own", S.fit(), 1)):
        got = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == "crf"} for r in S.scan_secrets(rows, model).collect()}
        tagged = 0
        for i, text in enumerate(texts):
            found = [(m.start(), m[0]) for m in S.re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
            tokens, want = [t for _, t in found], set()
            raw = (text or "").encode()
            file = S.file_features(int(S.SYMBOL[list(raw)].sum()), len(raw), sum(any(c in "0123456789" for c in t) for t in tokens), len(tokens))
            tags = model.decode([S.features(t, tokens[max(0, k - 3) : k], tokens[k + 1 : k + 3], file) for k, t in enumerate(tokens)], False) if tokens else []
            k = 0
            while k < len(tags):
                j = k + 1
                if tags[k] != 2:
                    while j < len(tags) and tags[j] == 1:
                        j += 1
                    a, b = found[k][0] + len(tokens[k]) - len(tokens[k].lstrip(S._EDGE)), found[j - 1][0] + len(tokens[j - 1].rstrip(S._EDGE))
                    base = S.base_spans(text)
                    if a < b and not any(a < y and x < b for _, x, y in base):
                        want.add((a, b))
                        tagged += all(t.isalpha() and len(t) < 24 for t in tokens[k:j])
                k = j
            assert got[i] == want, (name, i, text)
        assert tagged >= least, (name, tagged)


def odd_texts(spark):
    made = [(i, " ".join(f"w{(i * i + 7 * j) % 40}" for j in range(i % 23)) + f" common c{i % 3}") for i in range(240)]
    made += [(300, made[5][1]), (301, made[5][1]), (320, ""), (340, None), (None, "common w1"), (360, "nowhere")]
    return spark.createDataFrame(made, "doc_id long, text string")


def test_many_long_queries_are_searched_without_a_join_of_postings(spark, monkeypatch):
    """Postings met queries' terms in a join, whose rows grow with the square of the documents."""
    d = odd_texts(spark)
    q = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    plan = L.neighbours(q.withColumnRenamed("query_id", "doc_id"), d.withColumnRenamed("doc_id", "pid"), 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and " * weight" not in plan
    for tokens, step, min_df, docs in ((500_000, 256, 2, d), (60, 3, 2, d), (60, 256, 1, d), (300, 5, 3, d), (60, 3, 1, d.where("doc_id < 4")), (60, 3, 2, d.limit(0))):
        monkeypatch.setattr(bulk, "TOKENS", tokens)
        monkeypatch.setattr(bulk, "STEP", step)
        want = {(r.query_id, r.rank): (r.doc_id, r.score) for r in lexical.search(docs, q, 7, min_df).collect()}
        found = bulk.search(docs, q, 7, min_df).collect()
        got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in found}
        assert len(found) == len(got) and {x: y[0] for x, y in got.items()} == {x: y[0] for x, y in want.items()}
        assert all(abs(got[x][1] - want[x][1]) < 3e-9 for x in want)


def test_neighbours_that_fill_both_sides_are_dealt_alone(spark):
    """All 900 fillers of each searched document met the digests and the passages that contain it."""
    made = [(i, f"p{i} first second third {'x' * 70}{i} " + f"w{i % 7} " * (20 + i % 50)) for i in range(260)]
    made += [(300 + i, f"in {made[i][1]} out") for i in range(0, 60, 3)] + [(400, made[0][1]), (420, "two words"), (440, ""), (460, None)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    seeds, pool = d.where("doc_id % 20 = 0"), d.where("length(text) > 9").select(F.col("doc_id").alias("pid"), "text")
    key = lambda rows: sorted(map(tuple, rows.collect()), key=str)
    for least, k in ((500, 50), (40_000, 250), (90_000, 250)):
        want = key(L.dealt(L.without_own(L.drawn(seeds, pool, "bm25", k), seeds, pool, 2 * least), least))
        assert want and key(L.chosen(seeds, pool, least, "bm25", k)) == want
    assert key(L.containing(seeds, pool, few=True)) == key(L.containing(seeds, pool)) != []
    assert L.chosen(seeds, pool, 500, "bm25", 50)._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_every_document_draws_neighbours(spark, monkeypatch):
    """Only documents of ids divisible by 20 were searched."""
    from quarry.plans import registry

    sf, d = "/root/testdata/sf0.001", odd_texts(spark)
    rows = registry.queries()["r07_bm25_filler"](spark, sf)
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    seeds, pool = d.where("doc_id is not null"), d.withColumnRenamed("doc_id", "pid")
    key = lambda rows: sorted(map(tuple, rows.select("doc_id", "nth", "pid").collect()), key=str)
    monkeypatch.setattr(bulk, "TOKENS", 300)
    for k, depth, ranged in ((50, 7, 60), (300, 12, 300), (40, 300, 64)):
        near = L.neighbours(seeds, pool, depth, many=True)
        assert key(near) == key(L.neighbours(seeds, pool, depth)) != []
        assert key(R.topped(near, seeds, pool, k, depth, rows=ranged)) == key(L.drawn(seeds, pool, "bm25", k, depth))
    assert not R.topped(near, seeds, pool.limit(0)).count()


def leaking(spark):
    """Seeds with twenty fillers and more each, all of a pool, and judgements that want one which no row records."""
    made = [(i, f"p{i} first second third " + "yé " * (20 + i % 9)) for i in range(60)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    seeds, pool = d.where("doc_id % 12 = 0").withColumn("is_gold", F.col("doc_id") % 24 == 0), d.where("doc_id % 12 > 0").select(F.col("doc_id").alias("pid"), "text")
    rows = R.welded(seeds, pool, "random", (300, 2000), 40, ("gold_once", "nests", "fillers"), rows=40)
    beyond = rows.where("doc_id = '12'").select(F.explode(F.array_except("fillers", "distractor_ids")).alias("pid")).agg(F.min("pid")).first()[0]
    return d, seeds, pool, rows, spark.createDataFrame([("q", int(beyond), 1)], "query_id string, doc_id long, score int"), beyond


def test_leaks_are_sought_among_all_fillers(spark):
    """Only the sixteen recorded fillers of a row were looked at."""
    from quarry.plans import registry

    _, seeds, pool, rows, wanted, beyond = leaking(spark)
    rows = rows.persist()
    own = rows.where("doc_id = '12'")
    assert V.no_leaks(own.drop("fillers"), wanted).first().violations == 0
    assert V.no_leaks(own, wanted).first().violations == own.where(F.array_contains("fillers", beyond)).count() > 0
    want = L.ladder(seeds, L.tapes(L.dealt(L.without_own(L.drawn(seeds, pool, "random", 40), seeds, pool, 4000), 2000), pool), "random", (300, 2000), facts=("fillers",))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "rung_chars", "position_bin", "distractor_ids", "fillers").collect()))
    assert key(rows) == key(want) and rows.where("size(fillers) > 16 and size(distractor_ids) = 16").count() > 0
    plan = registry.queries()["v11_filler_leakage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "fillers" in plan


def test_the_suite_seeks_leaks_among_all_fillers(spark):
    """The suite's facts held the sixteen recorded fillers of a row only."""
    from quarry.plans import registry

    d, seeds, _, rows, wanted, _ = leaking(spark)
    got = {r.check: r.violations for r in V.suite(V.facts(rows), seeds, wanted).collect()}
    assert got["filler_leakage"] > 0 and got["ids"] == got["golds_exist"] - 1 == 0
    plan = registry.queries()["v15_verification_suite"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "fillers" in plan


def test_a_search_reads_its_documents_once(spark):
    """The join with rare terms dealt blocks anew, from texts that were parted into tokens a second time."""
    made = [(i, " ".join(f"w{(i * i + 7 * j) % 40}" for j in range(5 + i % 23)) + f" common c{i % 3}") for i in range(240)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    q = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        plan = bulk.search(d, q, 7)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum("MapInArrow" in line and "tokens#" in line for line in plan.split("\n")) == 1
