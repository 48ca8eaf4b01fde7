"""What a session needs before Python functions of this library run on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def send_source(spark: SparkSession) -> None:
    """Give executors the library's source files, once for each context; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quarry_sent", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry_source.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    context._quarry_sent = True
