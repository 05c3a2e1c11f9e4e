"""Structured Streaming: new pages become chunks, batch by batch, with the same plan as the batch path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.config import DEFAULTS
from tessera.operators.chunking import chunk_pages


def ingest(pages: DataFrame, path: str, checkpoint: str, max_tokens: int = DEFAULTS.chunk_tokens, overlap: int = DEFAULTS.overlap_tokens, once: bool = True) -> StreamingQuery:
    """Chunk a stream of pages (source, page, text) into Parquet folders below `path`, one a micro-batch.

    A source must arrive whole in one batch, as its chunks are numbered over all its pages. A batch that is run again
    after a failure overwrites its own folder, so every page counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunk_pages(batch, max_tokens, overlap).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
