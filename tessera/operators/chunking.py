"""Pages to sentence-aware chunks that never cross a page."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.config import DEFAULTS
from tessera.functions import text as T
from tessera.tables import deleted, stored, work_dir

#: Pages (16 bytes each) whose first indexes are sent to all tasks at most.
BROADCAST_PAGES = 1_000_000


#: Both kinds of ends at once.
ENDS = re.compile(f"{T.BLANK_LINES}|{T.SENTENCE_END}".replace(T.SPACE, r"\s"))
LONE_NUMBER = re.compile(r"\d+\.")


def sentences(text: str) -> Iterator[str]:
    """What `functions.text.split_sentences` gives; the tests compare them."""
    number = ""
    for piece in filter(None, map(str.strip, ENDS.split(text))):
        if number:
            yield f"{number} {piece}"
            number = ""
        elif LONE_NUMBER.fullmatch(piece):
            number = piece
        else:
            yield piece
    if number:
        yield number


def packed(text: str, max_tokens: int, overlap: int) -> list[str]:
    """Chunks of a text: of units, sentences or slices of over-long ones, by the running sum of their token estimates.

    A chunk goes on as long as the sum allows. The next one begins with the last units that fit into the overlap, and
    takes one more in any case.
    """
    step = max(1, int(max_tokens / 1.3))
    texts: list[str] = []
    sums = [0]
    for sentence in sentences(text):
        words = sentence.split()
        if int(len(words) * 1.3) + 1 > max_tokens:
            parts = [words[i : i + step] for i in range(0, len(words), step)]
            texts += map(" ".join, parts)
        else:
            parts = [words]
            texts.append(sentence)
        for part in parts:
            sums.append(sums[-1] + int(len(part) * 1.3) + 1)
    chunks, begin, end = [], 0, 0
    while end < len(texts):
        end = max(end + 1, bisect_right(sums, sums[begin] + max_tokens) - 1)
        chunks.append(" ".join(texts[begin:end]))
        begin = max(begin, bisect_left(sums, sums[end] - overlap))
    return chunks


def chunk_text(text: Column, max_tokens: int = DEFAULTS.chunk_tokens, overlap: int = DEFAULTS.overlap_tokens) -> Column:
    """The chunks of each text. Arrow-batched: Column expressions give the same, several times slower."""

    @F.pandas_udf(ArrayType(StringType()))
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else packed(t, max_tokens, overlap))

    return chunks(text)


def page_digest() -> Column:
    return F.conv(F.substring(F.sha1(F.concat_ws(":", F.col("page").cast("string"), "text")), 1, 8), 16, 10).cast("long")


def document_keys(pages: DataFrame) -> DataFrame:
    """source, doc_key: 8 hexadecimal digits over the digests of all pages, added up so that no task needs a whole source."""
    pages = pages if "digest" in pages.columns else pages.withColumn("digest", page_digest())
    return pages.groupBy("source").agg(F.sum("digest").alias("s"), F.count("*").alias("n")).select("source", document_key("n", "s").alias("doc_key"))


def document_key(pages: str, digests: str) -> Column:
    """From the number of a source's pages and the sum of their digests."""
    return F.substring(F.sha1(F.concat_ws(":", "source", F.col(pages).cast("string"), F.col(digests).cast("string"))), 1, 8)


def first_indexes(pages: DataFrame, folder: str) -> DataFrame:
    """row, first: the chunks of a source before each page. pages: row, source, page, n.

    Pages are dealt out in order, so a running sum needs its own part, and the sums of the parts before it.
    """
    dealt = pages.select("row", "source", "page", "n").repartitionByRange("source", "page", "row").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, folder, "dealt")
    before = lambda by: by.rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("source", "part").agg(F.sum("n").alias("total"))  # a row for each part and its sources
    bases = totals.select("source", "part", F.coalesce(F.sum("total").over(before(W.partitionBy("source").orderBy("part"))), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(before(W.partitionBy("source", "part").orderBy("page", "row"))), F.lit(0)).alias("own")
    return dealt.select("row", "source", "part", own).join(bases, ["source", "part"]).select("row", (F.col("base") + F.col("own")).alias("first"))


def chunk_pages(pages: DataFrame, max_tokens: int = DEFAULTS.chunk_tokens, overlap: int = DEFAULTS.overlap_tokens) -> DataFrame:
    """id, text, page, source, index of all chunks; pages: source, page, text.

    The index runs over a source's pages. Packing is the costly step, so its result is written once, a row a page with
    its chunks; only the pages' chunk counts are put in order. Up to `BROADCAST_PAGES` of them go to all tasks, so that
    no text is shuffled; beyond that pages are joined to theirs.
    """
    folder = work_dir(pages.sparkSession, "chunks")
    packed = stored(packed_pages(pages, max_tokens, overlap).select(F.monotonically_increasing_id().alias("row"), "*"), folder, "pages")
    chunks = stored(numbered(packed, folder), folder, "chunks")
    deleted(pages.sparkSession, folder, "pages", "dealt")
    return chunks


def packed_pages(pages: DataFrame, max_tokens: int = DEFAULTS.chunk_tokens, overlap: int = DEFAULTS.overlap_tokens) -> DataFrame:
    """pages (source, page, text, ...) with chunks, their number n and the page's digest in place of the text."""
    packed = pages.withColumn("chunks", chunk_text(F.col("text"), max_tokens, overlap)).withColumn("digest", page_digest()).drop("text")
    return packed.withColumn("n", F.coalesce(F.size("chunks"), F.lit(0)))


def numbered(packed: DataFrame, folder: str) -> DataFrame:
    """id, text, page, source, index of the chunks of a written table: row (a number of its own), source, page, chunks, n, digest."""
    first = first_indexes(packed, folder)
    keys = document_keys(packed)
    if packed.count() <= BROADCAST_PAGES:
        first, keys = F.broadcast(first), F.broadcast(keys)  # a page has one source
    rows = packed.join(first, "row").join(keys, "source").select("doc_key", "first", "page", "source", F.posexplode("chunks").alias("pos", "text"))
    index = F.col("first") + F.col("pos")
    return rows.select(F.concat_ws(":", "doc_key", index.cast("string")).alias("id"), "text", "page", "source", index.cast("long").alias("index"))


def document_registry(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.countDistinct("id").alias("n_chunks"))
