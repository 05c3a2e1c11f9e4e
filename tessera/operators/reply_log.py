"""Replies that are paid for once: a log of replies by what was asked.

A prompt's digest covers all that a reply depends on: system text, user text, models, reply form and length. Prompts with one
digest are one call. Tasks write each reply to a file named by its digest as it comes, and look for that file before a call, so neither a
task that runs again nor a job that was killed pays again; at most the calls under way are lost. When a run is through, its replies
go to a Parquet table, and their files go away.

A task has a bounded number of calls under way and takes each from a token bucket; `rate` is for all tasks together. Failed calls are
rows with an error and are not logged, so that the next run tries them again.

Defined results: a null prompt is asked as an empty one; rows with equal prompts get the same reply; an empty table makes no call.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULTS
from tessera.files import content, created, removed
from tessera.operators.generation import ANSWER_TOKENS, Client, complete
from tessera.tables import deleted, stored, work_dir

SCHEMA = "digest string, reply string, model string"
#: Tasks that call, and calls that each has under way, at most.
TASKS, TOGETHER = 8, 4


class TokenBucket:
    """Lets `rate` calls a second pass, and `burst` at once after a rest."""

    def __init__(self, rate: float, burst: float = 1.0, now: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.now, self.wait = rate, burst, now, wait
        self.held, self.at, self.lock = burst, now(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            at = self.now()
            self.held = min(self.burst, self.held + (at - self.at) * self.rate) - 1  # below zero: promised to those who wait
            self.at = at
            missing = -self.held / self.rate if self.held < 0 else 0.0
        if missing:
            self.wait(missing)


def digest(prompt: Column, system: str, models: tuple[str, ...], json_mode: bool, max_tokens: int) -> Column:
    asked = F.to_json(F.array(*[F.lit(x) for x in (system, *models, str(json_mode), str(max_tokens))], F.coalesce(prompt, F.lit(""))))
    return F.sha2(asked, 256)


def place(name: str) -> str:
    return f"{name[:2]}/{name}.json"


def opened(spark: SparkSession, log: str) -> DataFrame:
    """digest, reply, model of all that is logged below a path; a new log where there is none."""
    created(f"{log}/calls/_log", b"")
    if created(f"{log}/replies/_log", b""):
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(f"{log}/replies")
    files = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{log}/calls")
    return spark.read.schema(SCHEMA).parquet(f"{log}/replies").union(files).groupBy("digest").agg(F.min(F.struct("reply", "model")).alias("r")).select("digest", "r.*")


def logged(
    rows: DataFrame, key: str, load: Callable[[], Client], system: str, log: str, models: tuple[str, ...] = DEFAULTS.models, json_mode: bool = False,
    max_tokens: int = ANSWER_TOKENS, tasks: int = TASKS, together: int = TOGETHER, rate: float | None = None, retries: int = 2, wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """key, reply, model, error for each prompt, like `generation.replies`; calls only for what the log does not hold."""
    spark = rows.sparkSession
    folder = work_dir(spark, "replies")
    asked = stored(rows.select(key, F.coalesce("prompt", F.lit("")).alias("prompt"), digest(F.col("prompt"), system, models, json_mode, max_tokens).alias("digest")), folder, "asked")
    known = opened(spark, log)
    fresh = asked.groupBy("digest").agg(F.min("prompt").alias("prompt")).join(known.select("digest"), "digest", "left_anti").repartition(tasks, "digest")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        bucket = TokenBucket(rate / tasks) if rate else None

        def one(item: tuple[str, str]) -> tuple[str, str | None, str | None, str | None]:
            name, prompt = item
            path = f"{log}/calls/{place(name)}"
            try:
                before = json.loads(content(path))  # an earlier attempt has paid
                return name, before["reply"], before["model"], None
            except FileNotFoundError:
                pass
            try:
                if bucket:
                    bucket.take()
                reply, model = complete(client, list(models), system, prompt, json_mode, max_tokens, retries, wait)
            except Exception as error:  # noqa: BLE001  a failed call is a row, not a failed job
                return name, None, None, f"{type(error).__name__}: {error}"
            created(path, json.dumps({"digest": name, "reply": reply, "model": model}).encode())
            return name, reply, model, None

        with ThreadPoolExecutor(together) as pool:
            for batch in batches:
                if client is None and len(batch):
                    client = load()
                items = list(zip(batch["digest"], batch["prompt"], strict=True))
                yield pd.DataFrame(list(pool.map(one, items)), columns=["digest", "reply", "model", "error"])

    found = stored(fresh.mapInPandas(call, f"{SCHEMA}, error string"), folder, "found")
    paid = found.where("error is null").select("digest", "reply", "model")
    paid.write.mode("append").parquet(f"{log}/replies")

    def forget(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            removed(f"{log}/calls", [place(name) for name in batch["digest"]])
            yield pd.DataFrame({"n": [len(batch)]})

    paid.select("digest").mapInPandas(forget, "n long").agg(F.sum("n")).collect()
    answers = opened(spark, log).withColumn("error", F.lit(None).cast("string")).union(found.where("error is not null"))
    out = stored(asked.join(answers, "digest", "left").select(key, "reply", "model", "error"), folder, "out")
    deleted(spark, folder, "asked", "found")
    return out
