"""Incremental enrichment over shards, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.enrichment import gate, keyed, to_insert
from quarry.sources.readers import exists


class Killed(RuntimeError):
    """A run that had begun is started again without the wish to resume it."""


class Stopped(RuntimeError):
    """The batch before did not pass its gate; this one is left for a run that resumes."""


class Ladder:
    """Shards in order through prefill, translation, cache, accumulation and a gate.

    Each micro-batch is one shard file (the stream's checkpoint remembers which are done), and what it
    writes is under its batch number, so a batch that runs again after a crash replaces its own rows
    and nothing is counted twice. A batch whose scores do not pass stops the ladder after it: the next
    batch fails before it does or commits anything, so a run that resumes takes it and all later ones.
    """

    def __init__(self, spark: SparkSession, source: str, schema: str, out: str, translate: Callable, judge: Callable, model: str = "stub", prompt: str = "p", pilot: DataFrame | None = None):
        self.spark, self.source, self.schema, self.out = spark, source, schema, out
        self.translate, self.judge, self.model, self.prompt, self.pilot = translate, judge, model, prompt, pilot
        self.stopped = False

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.out}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def cache(self, before: int | None = None) -> DataFrame:
        """(key, translation) of all batches, or of those before one."""
        rows = self._read("cache", "key string, translation string, batch long")
        return (rows if before is None else rows.where(F.col("batch") < before)).select("key", "translation")

    def step(self, batch: DataFrame, number: int) -> None:
        """One shard."""
        if self.stopped:
            raise Stopped(f"the gate was not passed before batch {number}")
        rows = keyed(batch, self.model, self.prompt)
        known = self.cache(number)
        fresh = rows.select("key", "text").dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
        made = fresh.withColumn("translation", self.translate(F.col("text"))).select("key", "translation")
        done = rows.join(known.unionByName(made), "key").withColumn("batch", F.lit(number).cast("long"))
        place = lambda name: f"{self.out}/{name}/batch={number}"
        done.drop("batch").write.mode("overwrite").parquet(place("accumulated"))
        stored = self.spark.read.parquet(place("accumulated"))
        to_insert(stored, known, "_id").write.mode("overwrite").parquet(place("cache"))
        scored = stored.select(self.judge(F.col("text"), F.col("translation"))["score"].alias("score"))
        passed = gate(scored, self.pilot).withColumn("rows", F.lit(stored.count()))
        passed.write.mode("overwrite").parquet(place("history"))
        self.stopped = not self.spark.read.parquet(place("history")).first()["passed"]

    def run(self, resume: bool = False, shards_at_once: int = 1) -> DataFrame:
        """All shards that are there and not yet done; the history of all batches."""
        checkpoint = f"{self.out}/checkpoint"
        if exists(self.spark, checkpoint) and not resume:
            raise Killed(f"{checkpoint} is there: pass resume=True to go on")
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", shards_at_once).option("latestFirst", False).parquet(self.source)
        self.stopped = False
        running = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            running.awaitTermination()
        except StreamingQueryException:
            if not self.stopped:
                raise
        return self.history()

    def history(self) -> DataFrame:
        return self._read("history", "mean double, std double, n long, z double, passed boolean, rows long, batch long")

    def accumulated(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/accumulated")


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by windows of event time; late rows are waited for as long as given (streams)."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no gap as long as given."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, key: str, late: str) -> DataFrame:
    """Rows whose key was not seen within the time that late rows are waited for."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
