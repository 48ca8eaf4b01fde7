"""Phases of each dataset's run, recorded so that a second start goes on where the first one stopped."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import seed64
from quarry.sources.readers import exists, listing

# The phases, in order.
PHASES = ("candidates", "pilot", "pilot_qa", "full", "qa", "titles", "export")


class Phases:
    """Runs phases for datasets; a phase that is recorded is skipped, and a failure stops its dataset only."""

    def __init__(self, spark: SparkSession, log: str, steps: dict[str, Callable[[str], object]], order: tuple[str, ...] = PHASES):
        self.spark, self.log, self.steps, self.order = spark, log, steps, [p for p in order if p in steps]

    def done(self) -> set[tuple[str, str]]:
        if not exists(self.spark, self.log):
            return set()
        rows = self.spark.read.schema("dataset string, phase string, ok boolean, detail string").json(self.log)
        return {(r.dataset, r.phase) for r in rows.where("ok").select("dataset", "phase").collect()}  # a row for each phase that ran

    def record(self, dataset: str, phase: str, ok: bool, detail: str) -> None:
        self.spark.createDataFrame([(dataset, phase, ok, detail)], "dataset string, phase string, ok boolean, detail string").coalesce(1).write.mode("append").json(self.log)

    def run(self, datasets: list[str]) -> dict[str, str]:
        """The last phase that each dataset reached, or what stopped it."""
        state, known = {}, self.done()
        for dataset in datasets:
            for phase in self.order:
                if (dataset, phase) in known:
                    state[dataset] = phase
                    continue
                try:
                    made = self.steps[phase](dataset)
                except Exception as e:
                    self.record(dataset, phase, False, str(e)[:500])
                    state[dataset] = f"failed in {phase}: {e}"
                    break
                if made is False:  # a gate that did not let it pass
                    self.record(dataset, phase, False, "stopped")
                    state[dataset] = f"stopped at {phase}"
                    break
                self.record(dataset, phase, True, json.dumps(made) if isinstance(made, (int, float, str)) else "")
                state[dataset] = phase
        return state


def latest_run(spark: SparkSession, root: str) -> str | None:
    """The last run's folder by name."""
    return max((path for path, _ in listing(spark, f"{root}/*")), default=None)


def cache_key(arm: str, strategy: str, window: int, stride: int, source_time: int) -> str:
    """Name of a cache of vectors: whatever they depend on is in it, the time of their source too."""
    return f"{arm}-{strategy}-w{window}-s{stride}-t{source_time}"


def encoded_in_parts(rows: DataFrame, path: str, encode: Callable, parts: int = 16, id_col: str = "doc_id") -> DataFrame:
    """Vectors of rows, part by part; a part that is written is not made again.

    Parts are by the stable hash of the id, so a second run with the same rows finds them.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("part", (seed64(F.col(id_col)) % parts).cast("int"))
    for part in range(parts):
        place = f"{path}/part={part}"
        if not exists(spark, f"{place}/_SUCCESS"):
            dealt.where(F.col("part") == part).select(id_col, encode(F.col("text")).alias("embedding")).write.mode("overwrite").parquet(place)
    return spark.read.parquet(path).drop("part")
