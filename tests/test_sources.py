"""Readers and writers over small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quarry.sources import readers as R
from quarry.sources import sinks as K


@pytest.fixture
def beir(tmp_path):
    """A small collection: corpus, queries, and judgements in both formats."""
    (tmp_path / "qrels").mkdir()
    docs = [{"_id": "d1", "title": " T ", "text": " one "}, {"_id": "d2", "title": "", "text": "two"}, {"_id": "d3", "title": None, "text": "three"}]
    (tmp_path / "corpus.jsonl").write_text("\n".join(map(json.dumps, docs)))
    (tmp_path / "queries.jsonl").write_text(json.dumps({"_id": "q1", "text": "ask"}))
    (tmp_path / "qrels/test.jsonl").write_text("\n".join(json.dumps({"query-id": "q1", "corpus-id": f"d{i}", "score": i - 1}) for i in (1, 2, 3)))
    (tmp_path / "qrels/train.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\nq1\tshort\nq1\td3\tx\nq2\td3\t2.0\n")
    return str(tmp_path)


def test_collection(spark, beir):
    assert {tuple(r) for r in R.corpus(spark, beir).collect()} == {("d1", "T one"), ("d2", "two"), ("d3", "three")}
    assert {r.text for r in R.corpus_raw(spark, beir).collect()} == {"one", "two", "three"}
    assert R.queries(spark, beir).first().query_id == "q1"
    assert {tuple(r) for r in R.qrels(spark, beir).collect()} == {("q1", "d2", 1), ("q1", "d3", 2)}
    assert {tuple(r) for r in R.qrels(spark, beir, "train").collect()} == {("q1", "d1", 1), ("q2", "d3", 2)}
    assert R.qrels_any(spark, beir).count() == 3
    assert R.positives(spark, beir).count() == 4
    with pytest.raises(FileNotFoundError):
        R.qrels_any(spark, beir, ["dev"])


def test_latest_corpora(spark, tmp_path):
    import os

    for i, run in enumerate(("a", "b")):
        folder = tmp_path / f"runs/{run}/corpus/fiqa/beir"
        folder.mkdir(parents=True)
        (folder / "corpus.jsonl").write_text("{}")
        os.utime(folder / "corpus.jsonl", (1000 + 100 * i, 1000 + 100 * i))
    assert "/runs/b/" in R.latest_corpora(spark, str(tmp_path))["fiqa"]
    with pytest.raises(FileNotFoundError):
        R.latest_corpora(spark, str(tmp_path), ["other"])


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"Text": "x", "ID": 1}\n{bad\n{"Text": "y", "ID": 2}\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"Text": "z", "ID": 3}\n')
    rows = R.json_lines(spark, [str(tmp_path)]).orderBy("id").collect()
    assert [(r.text, r._file, r._row_number) for r in rows] == [("x", "a.jsonl", 0), ("y", "a.jsonl", 1), ("z", "b.jsonl", 0)]
    assert len(rows[0].guid) == 64
    assert R.json_lines(spark, [str(tmp_path)], guid_field="id", exclude=["b.json"]).select("guid").distinct().count() == 2
    assert R.json_lines(spark, [str(tmp_path)], limit=1).count() == 2


def test_json_tree(spark, tmp_path):
    for name in ("keep/a", "keep/Skip", "other/b"):
        path = tmp_path / f"{name}.json.gz"
        path.parent.mkdir(exist_ok=True)
        with gzip.open(path, "wt") as f:
            f.write(json.dumps({"id": name, "text": "t", "source": "s"}))
    assert {r.id for r in R.json_tree(spark, str(tmp_path), ["keep"], ["skip"]).collect()} == {"keep/a"}
    assert R.json_tree(spark, str(tmp_path), exclude=["keep"]).count() == 1


def test_tables(spark, tmp_path):
    spark.createDataFrame([(1, None, "t")], "_id int, title string, text string").write.parquet(str(tmp_path / "p"))
    assert tuple(R.parquet_corpus(spark, [str(tmp_path / "p")]).first()) == ("1", "", "t")
    parts = {"x": spark.createDataFrame([(1,)], "_id int"), "y": spark.createDataFrame([(1, "b")], "_id int, b string")}
    assert {r._id for r in R.subsets(parts).collect()} == {"x_1", "y_1"}
    got = R.first_that_reads(lambda: spark.read.parquet(str(tmp_path / "none")), lambda: spark.read.parquet(str(tmp_path / "p")))
    assert got.count() == 1


def test_qa_and_csv(spark, tmp_path):
    qa = {"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q", "answers": [{"text": "a"}, {"text": "b"}]}, {"id": "2", "question": "r", "answers": []}]}, {"context": "d", "qas": []}]}]}
    (tmp_path / "qa.json").write_text(json.dumps(qa, indent=1))
    assert {(r.question_id, r.answer) for r in R.qa_pairs(spark, str(tmp_path / "qa.json")).collect()} == {("1", "a"), ("2", None)}
    (tmp_path / "s").mkdir()
    (tmp_path / "s/0.csv").write_text('a,b\n1,"x\ny"\n2,"say ""hi"""\n')
    (tmp_path / "s/1.csv").write_text("a,b\n3,z\n")
    assert [r.b for r in R.csv(spark, str(tmp_path / "s/0.csv"), ["b"]).collect()] == ["x\ny", 'say "hi"']
    assert R.header(spark, str(tmp_path / "s/0.csv")) == ["a", "b"]
    assert R.first_shards(spark, str(tmp_path / "s"), 2).count() == 2 and R.first_shards(spark, str(tmp_path / "s"), 9).count() == 3


def test_results_and_predictions(spark, tmp_path):
    folder = tmp_path / "evaluations/fiqa/org/model-1/prompt/judge"
    folder.mkdir(parents=True)
    (folder / "queries.csv").write_text("_id,score\n1,5\n")
    r = R.results_tree(spark, str(tmp_path)).first()
    assert (r.dataset_slug, r.translation_model, r.prompt_slug, r.judge_model, r.text_type) == ("fiqa", "org/model-1", "prompt", "judge", "queries")
    good = {"key": "k", "response": {"candidates": [{"content": {"parts": [{"text": "hi"}]}}], "usageMetadata": {"promptTokenCount": 7}}}
    (tmp_path / "p.jsonl").write_text(json.dumps(good) + "\n{broken\n")
    assert [tuple(x) for x in R.predictions(spark, [str(tmp_path / "p.jsonl")]).collect()] == [("k", "hi", 7)]


def test_filler_caps_prefixes_and_configuration(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((100, 300, 400, 5000))], "position long, text string")
    assert [r.pid for r in R.neutral_filler(rows, n=1).collect()] == ["ext1"]
    capped = R.capped(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "d string, i int"), "d", 1, ["i"])
    assert {r.i for r in capped.collect()} == {1, 3}
    t = spark.createDataFrame([("q", "p", "n", "")], "query string, positive string, hard_neg_0 string, hard_neg_1 string")
    assert tuple(R.prefixed(t, task="s").first()) == ("[s] query: q", "passage: p", "passage: n", "")
    (tmp_path / "a.jsonl").write_text('{"text": "x", "lang": "en"}\n{"text": "x", "lang": "en"}\n{"text": "y", "lang": "fr"}\n')
    config = {"defaults": {"type": "jsonl"}, "sources": [{"name": "one", "files": [str(tmp_path / "a.jsonl")], "filter_criteria": [{"lang": "en"}]}]}
    assert [r.text for r in R.build(spark, config).collect()] == ["x"]
    assert R.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_welded_corpus(spark, tmp_path):
    rows = [("d", "random", 10, "start", g, i) for g, i in ((False, "a"), (True, "b"))] + [("d", "random", 10, "end", True, "b")]
    spark.createDataFrame(rows, "dataset string, condition string, rung_chars int, position_bin string, is_gold boolean, doc_id string").write.parquet(str(tmp_path / "w"))
    assert R.welded_corpus(spark, str(tmp_path / "w"), "d", "random", 10, "end").count() == 2
    spark.createDataFrame([rows[0]], "dataset string, condition string, rung_chars int, position_bin string, is_gold boolean, doc_id string").write.mode("append").parquet(str(tmp_path / "w"))
    with pytest.raises(ValueError):
        R.welded_corpus(spark, str(tmp_path / "w"), "d", "random", 10, "end")


def test_writers(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    rows = spark.createDataFrame([(i, f"t\n{i}", "s", i) for i in range(10)], "id int, text string, _source string, _row_number int")
    K.records(rows, p("r"), 4)
    assert spark.read.parquet(p("r")).dtypes == [("text", "string"), ("_source", "string"), ("_row_number", "int")]
    K.lines(rows, p("t"))
    assert spark.read.text(p("t")).count() == 10
    K.json_lines(rows.withColumn("n", F.lit(None).cast("string")), p("j"))
    assert '"n":null' in spark.read.text(p("j")).first().value
    for _ in range(2):  # a second write leaves no stale shard
        m = K.sharded(rows, p("s"), 4, ["id"], "documents")
    assert {tuple(r) for r in m.collect()} == {("documents", 0, 4), ("documents", 1, 4), ("documents", 2, 2)}
    assert R.csv(spark, p("s") + "/documents").count() == 10
    K.append(rows, p("a"))
    K.append(rows, p("a"))
    assert spark.read.parquet(p("a")).count() == 20
    t = spark.createDataFrame([("d", 1, "T", "TT", "b", "src"), ("d", 0, "T", "TT", "a", "src"), ("d", 2, "T", "TT", " ", "src")], "_id string, segment_id int, title string, title_translation string, translation string, text string")
    q = spark.createDataFrame([("q", "x")], "_id string, text string")
    assert K.export(t, q, q, p("e")) == {"corpus": 1, "queries": 1, "qrels": 1}
    corpus = spark.read.json(p("e") + "/corpus")
    assert corpus.first().text == "a b"
    assert K.english_mirror(corpus.withColumn("text_en", F.lit(" ")), p("m")) == 1
    K.review(rows, p("v"), 3)
    index = spark.createDataFrame([(1, "a", 1.0)], "doc_id int, term string, weight double")
    K.index(index, p("i"), 2)
    assert spark.read.parquet(p("i")).count() == 1
    w = spark.createDataFrame([("random", 10, True, "end", "x")], "condition string, rung_chars int, is_gold boolean, position_bin string, text string")
    K.welded(w, p("w"))
    assert spark.read.parquet(p("w")).count() == 1
    assert K.dataset_manifest(spark, w, p("d"), seed=1) == {"seed": 1, "documents": {"10": 1}}
