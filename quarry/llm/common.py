"""What the operators of this package share: Arrow plumbing, table reading and lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.session import send_source

#: Bytes of text that one vectorised step holds; a longer text is a step of its own.
STEP_BYTES = 500_000
#: Sizes of batches between the JVM and Python: Spark's default, and what holds texts in bounded memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "8388608")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, rows: int | None = None, each: int = 100_000) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the cluster's ``spark.checkpoint.dir``; only where that is unset, in local mode
    (tests), a temporary folder of the driver is used. ``rows`` is about how many rows there are:
    a file then holds ``each`` of them, so that a small table isn't as many files as the shuffle has
    partitions. Where that would be more files than partitions, nothing changes.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-"))
    return (df if rows is None else df.coalesce(1 + rows // each)).checkpoint()


def arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow whose function may use this package: executors get its source files once.

    Rows here are whole texts, so a session that has Spark's own batch sizes gets smaller ones.
    """
    conf = df.sparkSession.conf
    for key, (default, ours) in BATCHES.items():
        if conf.get(key, default).rstrip("b") == default:
            conf.set(key, ours)
    send_source(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give what a task has freed back to the system: a worker waits for its next task as small as it can."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that nothing refers to any more.

    They go only when the driver's JVM finds the plans dead; after a checkpoint that replaces a large
    shuffle, that should not wait for its next full collection.
    """
    gc.collect()
    spark._jvm.System.gc()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column back to back, and each row's offset (one more than rows); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    rows = len(column)
    _, offsets, data = column.buffers()
    if offsets is None or rows == 0:
        return np.empty(0, np.uint8), np.zeros(rows + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + rows + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, of one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end
        row = end


def blocks(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over bounded parts of a batch's text column."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    for row, end in steps(offsets, most):
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values back to back and the length of each row's list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def annotate(
    df: DataFrame,
    fields: list[tuple[str, T.DataType, pa.DataType]],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Every row of ``df`` with new columns, made batch by batch in Python.

    ``make`` is called once for each task and returns the function of a batch. ``names`` renames
    the new columns; a column of ``df`` with a new column's name is replaced.
    """
    named = [((names or {}).get(name, name), kind, arrow) for name, kind, arrow in fields]
    fresh = {name.lower() for name, _, _ in named}
    kept = [f for f in df.schema.fields if f.name.lower() not in fresh]
    schema = T.StructType([*kept, *(T.StructField(name, kind, True) for name, kind, _ in named)])
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = [x if isinstance(x, pa.Array) else pa.array(x, arrow) for x, (_, _, arrow) in zip(work(batch), named)]
            at = [batch.schema.get_field_index(name) for name in keep]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), *made], names=[*keep, *(n for n, _, _ in named)])

    return arrow(df, run, schema)
