"""The batch variant, builders that recognise their configuration, and what the weld core may import."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.functions import stubs
from quarry.operators import enrichment as E
from quarry.sources import readers
from quarry.streaming.batch import Batch

SCHEMA = "dataset string, _id long, title string, text string, translation string"


@pytest.fixture
def rows(spark):
    made = [("a", i, " T ", f"text {i % 6} {'x' * 20}", None) for i in range(12)]
    made += [("b", 100 + i, None, f"#bad {i} {'x' * 20}", None) for i in range(3)]
    made += [("c", 200, "", "done", "DONE")]
    return spark.createDataFrame(made, SCHEMA)


def translate(t):
    return F.when(t.startswith("#bad"), "").otherwise(F.upper(t))


def test_batch_asks_once_and_gates_each_dataset(spark, rows, tmp_path):
    batch = Batch(spark, rows, str(tmp_path / "out"), stubs.judge)
    with pytest.raises(ValueError, match="pilot"):
        batch.submit()
    passed = {r.dataset: r.passed for r in batch.pilot(translate, 2).collect()}
    assert passed == {"a": True, "b": False}
    # Six texts stand twice each; two of them the pilot has translated.
    assert [tuple(r) for r in batch.submit().collect()] == [("a", 4)]
    answers = batch.requests().select("key", F.upper("text").alias("translation"))
    with pytest.raises(ValueError, match="no request"):
        batch.collect(answers.unionByName(spark.createDataFrame([("stray", "x")], "key string, translation string")), F.upper)
    # Answers that have not come yet leave their dataset open.
    first = batch.requests().agg(F.min("key").alias("key"))
    report = {r.dataset: r for r in batch.collect(answers.join(first, "key", "left_anti"), F.upper).collect()}
    assert (report["a"].open, report["a"].passed) == (2, False)
    report = {r.dataset: r for r in batch.collect(answers, F.upper).collect()}
    assert (report["a"].rows, report["a"].open, report["a"].passed) == (12, 0, True)
    # The failed dataset's third row was never asked for.
    assert (report["b"].open, report["b"].passed) == (1, False)
    out = batch.exported().where("dataset = 'a'").collect()
    assert len(out) == 12 and all(r.translation == r.text.upper() and r.title_translation == "T" for r in out)


def test_gates_agree_with_gate(spark):
    scores = spark.createDataFrame([(g, float(s)) for g, ss in {"x": (5, 5, 4), "y": (1, 2, 3), "z": (5,)}.items() for s in ss], "g string, score double")
    pilot = spark.createDataFrame([(g, float(s)) for g, ss in {"x": (5, 4, 5), "y": (5, 5, 4)}.items() for s in ss], "g string, score double")
    for r in E.gates(scores, pilot, "g").collect():
        own = pilot.where(F.col("g") == r.g)
        one = E.gate(scores.where(F.col("g") == r.g), None if r.g == "z" else own).first()
        assert (r.mean, r.std, r.n, r.z, r.passed) == (one.mean, one["std"], one.n, one.z, one.passed)


def test_builders_recognise_their_configuration(spark, monkeypatch):
    monkeypatch.setattr(readers, "BUILDERS", list(readers.BUILDERS))

    @readers.builder(lambda config: config.get("kind") == "numbers")
    def numbers(spark, config):
        return spark.range(config["n"])

    assert readers.discovered(spark, {"kind": "numbers", "n": 3}).count() == 3
    with pytest.raises(KeyError, match="kind"):
        readers.discovered(spark, {"kind": "none"})


def test_routes_of_columns_are_those_of_names(spark):
    names = ["GPT-4", "o3", "claude-x", "gemini-pro", "Qwen/a", "maker/b"]
    rows = spark.createDataFrame([(n,) for n in names + ["other"]], "model string").select("model", stubs.routed(F.col("model")).alias("service"))
    got = {r.model: r.service for r in rows.collect()}
    assert got == {n: stubs.route(n) for n in names} | {"other": None}


def test_weld_core_needs_no_tokenizer():
    code = "import sys, quarry.operators.longctx; print([m for m in ('tokenizers', 'tiktoken', 'sentencepiece', 'transformers') if m in sys.modules])"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "[]"
