"""What the operators of this subpackage share: work folders, byte-level words, bounded looks at a side's size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.tables import deleted, stored, work_dir  # noqa: F401  used by the operators from here

#: Bytes A-Z to lower case, every byte outside [0-9a-z] and the UTF-8 bytes of non-ASCII characters to a space:
#: after it, ``split()`` gives the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
PLAIN_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(PLAIN_WORDS).split()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind a folder's address, as Python workers reach it."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `size` bytes: what works on many rows in step needs more of them than a session's batch has."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


_turn: dict[str, Callable[[], None]] = {}


def take_turn(name: str, drop: Callable[[], None]) -> None:
    """Called as a task begins: what another operator has kept in this worker is dropped, as its turn is over."""
    if name not in _turn:
        for forget in _turn.values():
            forget()
        if _turn:
            _turn.clear()
            release()
        _turn[name] = drop


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and others need it then."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators read, under fixed names, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(id_column, folds: int, fold: int):
    """crc32 of the id as text, modulo folds, is fold; a null id is never held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join whose sides Spark can split where a key is hot.

    It splits only what it shuffles for the join itself, not what an aggregate has dealt out by the same keys before.
    One more key, made from the others, has both sides shuffled.
    """
    add = lambda df: df.withColumn("split_by", F.xxhash64(*keys))
    return add(left).join(add(right), [*keys, "split_by"], how).drop("split_by")


def freed(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files that no plan needs any more: it does so as the driver's garbage is collected.

    Once is not enough, as Python tells the JVM in its own time which plans it has let go of.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def keep_ids(docs: DataFrame, ids: DataFrame, how: str, bound: int = 2_000_000) -> DataFrame:
    """Semi or anti join on doc_id. Up to `bound` ids (8 bytes each) are counted and broadcast; more are shuffled."""
    few = ids.limit(bound + 1).count() <= bound
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)
