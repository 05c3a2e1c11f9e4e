"""A registry of sources from a stream of pages, in keyed state: running counts, sources that are whole, changes.

Three streaming queries follow each other, with exactly-once file sinks between them:

1. `pages`: every page is packed to chunks, without state.
2. `deltas`: a ledger keyed by source and a bucket of its pages holds (arrival, digest, chunks) of each page, so that a page which
   is sent again counts once, and a later text takes the place of an earlier one. It hands on what changes the source's sums. Texts
   and chunks do not pass it, and a source with a third of all pages is `BUCKETS` keys.
3. `registry`: a ledger keyed by source adds the changes up. A source is announced when it has as many pages as its
   `expected` says, or when nothing has come for `quiet` seconds (a timer); until then its pages are held back. If it changes
   afterwards, it is announced again with the next revision; what is sent again unchanged is not announced.

`registered` gives the newest announcement of each source, `indexed` the chunks of what is announced, numbered and with ids like those of
`chunking.chunk_pages`. Queries go on from their checkpoints after a stop.

Defined results: null text is an empty page; of versions of a page the one that arrived last counts, of equal arrivals that of the larger digest; without
a column `expected` only the timer announces; a null source is a source. A source that changed since its announcement is left
out of `indexed` until it is announced anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.config import DEFAULTS
from tessera.operators.chunking import document_key, numbered, packed_pages
from tessera.tables import deleted, stored, work_dir

#: Keys that the pages of a source are dealt out to.
BUCKETS = 64
#: Seconds without a page after which a source of unknown size counts as whole.
QUIET = 60.0
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batches write what changed, not a whole store each; a store, of which there is one a partition, takes no disk before it needs it.
STATE = {
    PROVIDER: ROCKS, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
PAGES = "source string, page long, expected long, arrived timestamp, chunks array<string>, digest long, n int"
DELTAS = "source string, pages long, chunks long, digests long, expected long"
REGISTRY = "source string, revision long, n_pages long, n_chunks long, digests long, why string"


class PageLedger(StatefulProcessor):
    """The pages of a bucket of a source."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page long", "arrived long, digest long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pages = chunks = digests = 0
        expected = None
        changed = False
        for batch in rows:
            for page, arrived, digest, n, told in batch[["page", "arrived_us", "digest", "n", "expected"]].itertuples(index=False, name=None):
                if told == told and told is not None:
                    expected = max(expected or 0, int(told))
                place = (int(page),)
                before = self.pages.getValue(place) if self.pages.containsKey(place) else None
                if before and (before[0], before[1]) >= (int(arrived), int(digest)):
                    continue
                self.pages.updateValue(place, (int(arrived), int(digest), int(n)))
                changed = changed or not before or before[1] != int(digest)
                pages += not before
                chunks += int(n) - (before[2] if before else 0)
                digests += int(digest) - (before[1] if before else 0)
        if changed or expected is not None:
            yield pd.DataFrame({"source": [key[0]], "pages": [pages], "chunks": [chunks], "digests": [digests], "expected": pd.array([expected], "Int64")})

    def close(self) -> None:
        pass


class SourceLedger(StatefulProcessor):
    """The sums of a source, and what was announced of it."""

    def __init__(self, quiet: float):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "pages long, chunks long, digests long, expected long")
        self.told = handle.getValueState("told", "revision long, pages long, digests long")

    def announced(self, key, why: str) -> Iterator[pd.DataFrame]:
        pages, chunks, digests, _ = self.sums.get()
        revision, *known = self.told.get() if self.told.exists() else (0, -1, 0)
        if [pages, digests] != known:
            self.told.update((revision + 1, pages, digests))
            yield pd.DataFrame({"source": [key[0]], "revision": [revision + 1], "n_pages": [pages], "n_chunks": [chunks], "digests": [digests], "why": [why]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums = list(self.sums.get() if self.sums.exists() else (0, 0, 0, 0))
        for batch in rows:
            for k, name in enumerate(("pages", "chunks", "digests")):
                sums[k] += int(batch[name].sum())
            told = batch["expected"].dropna()
            sums[3] = max([sums[3], *map(int, told)])
        self.sums.update(tuple(sums))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if sums[3] and sums[0] == sums[3]:
            yield from self.announced(key, "whole")
        elif not sums[3]:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.quiet * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sums.exists():
            yield from self.announced(key, "quiet")

    def close(self) -> None:
        pass


def ledger(pages: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Changes of the sources' sums, from packed pages."""
    rows = pages.select(
        "source", F.pmod(F.xxhash64("page"), F.lit(buckets)).alias("bucket"), "page", F.unix_micros("arrived").alias("arrived_us"), "digest", F.col("n").cast("long").alias("n"), "expected"
    )
    return rows.groupBy("source", "bucket").transformWithStateInPandas(PageLedger(), DELTAS, "Append", "None")


def announcements(deltas: DataFrame, quiet: float = QUIET) -> DataFrame:
    return deltas.groupBy("source").transformWithStateInPandas(SourceLedger(quiet), REGISTRY, "Append", "ProcessingTime")


def start(
    pages: DataFrame, path: str, max_tokens: int = DEFAULTS.chunk_tokens, overlap: int = DEFAULTS.overlap_tokens, quiet: float = QUIET, once: bool = True
) -> list[StreamingQuery]:
    """Follow a stream of pages (source, page, text, and expected and arrived if there are such) into tables below `path`.

    With `once` each query takes what is there and ends before the next begins; else all three run on.
    """
    spark = pages.sparkSession
    given = lambda name, kind, default: (F.col(name) if name in pages.columns else default).cast(kind).alias(name)
    named = pages.select(
        F.col("source").cast("string").alias("source"), F.col("page").cast("long").alias("page"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        given("expected", "long", F.lit(None)), given("arrived", "timestamp", F.current_timestamp()),
    )
    steps = [
        ("pages", lambda: packed_pages(named, max_tokens, overlap)),
        ("deltas", lambda: ledger(spark.readStream.schema(PAGES).parquet(f"{path}/pages"))),
        ("registry", lambda: announcements(spark.readStream.schema(DELTAS).parquet(f"{path}/deltas"), quiet)),
    ]
    running = []
    for name, rows in steps:
        to = lambda rows=rows, name=name: rows().writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoints/{name}").option("path", f"{path}/{name}")
        with settings(spark, STATE | {EMPTY_BATCHES: str(not once).lower()}):
            running.append((to().trigger(availableNow=True) if once else to()).start())
        if once:
            running[-1].awaitTermination()
    if once:
        with settings(spark, STATE):
            to().trigger(once=True).start().awaitTermination()  # a batch without data, for timers
    return running


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for queries that begin meanwhile: a query keeps those that it began with."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def registered(spark: SparkSession, path: str) -> DataFrame:
    """source, revision, n_pages, n_chunks, doc_key, why: the newest announcement of each source."""
    rows = spark.read.schema(REGISTRY).parquet(f"{path}/registry").groupBy("source").agg(F.max_by(F.struct("*"), "revision").alias("r")).select("r.*")
    return rows.select("source", "revision", "n_pages", "n_chunks", document_key("n_pages", "digests").alias("doc_key"), "why")


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """id, text, page, source, index of the chunks of sources that are announced and have not changed since."""
    folder = work_dir(spark, "indexed")
    pages = spark.read.schema(PAGES).parquet(f"{path}/pages")
    newest = pages.groupBy("source", "page").agg(F.max(F.struct("arrived", "digest", "n", "chunks")).alias("p")).select("source", "page", "p.digest", "p.n", "p.chunks")
    known = registered(spark, path).select("source", "doc_key")
    packed = stored(newest.select(F.monotonically_increasing_id().alias("row"), "*"), folder, "pages")
    chunks = numbered(packed, folder)
    same = chunks.join(known.withColumnRenamed("source", "known"), (F.split("id", ":")[0] == F.col("doc_key")) & F.col("source").eqNullSafe(F.col("known")), "left_semi")
    chunks = stored(same, folder, "chunks")
    deleted(spark, folder, "pages", "dealt")
    return chunks
