"""Written work tables: they cut a plan's lineage, so that nothing is computed twice and lost executors cost a re-read."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the cluster shares.

    Where that is unset, a temporary folder takes its place in local mode; on a cluster it is an error, as executors
    would each write to a disk of their own. Tables are needed as long as the DataFrame that was made from them; a scheduler may delete the folder
    of a finished job.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut the lineage with a written table."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete work tables that what was written since makes needless."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(conf).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files that no plan needs any more: it does so as the driver's garbage is collected, Python's plans first."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
