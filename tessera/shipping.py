"""Make the package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Set where the session leaves Spark's default (the first value): texts are long, so batches of that many rows take
#: a Python worker and its executor tens of megabytes, more than once.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "2097152b"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once an application, as `--py-files` would."""
    for name, (default, value) in BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, value)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
