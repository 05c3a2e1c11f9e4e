"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words (lower-cased A-Z, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`) are the letters of the search: the test strings are
the windows of `WINDOW` consecutive words of a benchmark item, or the whole item if it has fewer. Strings of one
length share a searcher. Its shift table, by the hash of a block of up to three words, says how far a block's end
lies from the nearest place where a string could end; a shift of 0 leads to a bucket, by the suffix block's hash, of
strings to compare word by word. Words outside the benchmark's vocabulary can be in no block, so they skip furthest.

A benchmark above `BENCHMARK_BYTES` is searched in as many passes, each a job of its own over all documents with its
share of the items, so that neither the driver nor a worker ever holds more than one share; what the passes find is
written and put together by row. The benchmark never meets the documents in a join.

Defined results: null or empty texts have no words; items without words are skipped, items without id mark words but
are not listed; repeated items count once by id; repeated rows are answered one by one; an empty benchmark hits
nothing; other columns are ignored (or kept, where asked for by name).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, plain_words, release, stored, take_turn, work_dir

WINDOW = 10
BLOCK = 3
#: Bytes of benchmark text that a worker searches for at once; its tables take some ten times as much.
BENCHMARK_BYTES = 8_000_000
#: The shift table has at most two to this power of entries.
MOST_BITS = 25
#: Words searched at once.
CHUNK_WORDS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
_searchers: dict[tuple, "Search"] = {}


def block_hash(words: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Hash of the block of `size` words that ends at each place from size - 1 on."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + n].astype(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(64 - bits)).astype(np.int64)


class Searcher:
    """All strings of one length m: the places of `flat`, the benchmark's words one item after the other, in starts."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, m: int):
        self.flat, self.m, self.size = flat, m, min(BLOCK, m)
        self.bits = min(MOST_BITS, max(10, len(starts).bit_length() + 5))
        self.shift = np.full(1 << self.bits, m - self.size + 1, np.uint8 if m < 200 else np.int32)
        hashes = block_hash(flat, self.size, self.bits)
        for end in range(self.size, m + 1):  # the nearest end is written last
            self.shift[hashes[starts + end - self.size]] = m - end
        suffix = hashes[starts + m - self.size]
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.starts = suffix[order], starts[order]

    def find(self, words: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(place, starts) of every occurrence. The walk jumps by the shift table and compares only at shift 0."""
        if len(words) < self.m:
            return
        hashes = block_hash(words, self.size, self.bits)
        shifts = self.shift[hashes]
        stops = np.flatnonzero(shifts == 0)
        if not len(stops):
            return
        at = self.m - self.size  # of the block's first word
        n = len(hashes)
        nearest = np.searchsorted(stops, at)
        while at < n and nearest < len(stops):
            step = int(shifts[at])
            if step:
                at += step
                if at > stops[nearest]:
                    nearest = np.searchsorted(stops, at)
                continue
            place = at + self.size - self.m
            here = words[place : place + self.m]
            bucket = self.starts[slice(*np.searchsorted(self.suffix, [hashes[at], hashes[at] + 1]))]
            if len(bucket):
                same = (self.flat[bucket[:, None] + np.arange(self.m)] == here).all(axis=1)
                if same.any():
                    yield place, bucket[same].tolist()
            at += 1
            nearest = np.searchsorted(stops, at)


class Search:
    """Vocabulary, searchers by length, and the item of each place."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        flat: list[np.ndarray] = []
        by_length: dict[int, list[np.ndarray]] = {}
        ends, self.names, at = [], [], 0
        seen: set[tuple[str | None, bytes]] = set()
        for item, text in items:
            if (item, text) in seen:
                continue
            seen.add((item, text))
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in plain_words(text)], np.int32)
            if not len(words):
                continue
            m = min(window, len(words))
            by_length.setdefault(m, []).append(at + np.arange(len(words) - m + 1))
            flat.append(words)
            at += len(words)
            ends.append(at)
            self.names.append(item)
        words = np.concatenate(flat) if flat else np.empty(0, np.int32)
        self.ends = np.array(ends, np.int64)
        self.searchers = [Searcher(words, np.concatenate(starts), m) for m, starts in sorted(by_length.items())]

    def items_at(self, starts: list[int]) -> set[str]:
        return {self.names[i] for i in np.searchsorted(self.ends, starts, side="right").tolist()} - {None}

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, list[int], set[str]]]:
        """For each text: words, starts and ends of marked spans (merged), items."""
        get, at = self.vocabulary.get, 0
        while at < len(texts):
            ids: list[int] = []
            sizes: list[int] = []
            while at < len(texts) and len(ids) < CHUNK_WORDS:
                words = plain_words(texts[at])
                sizes.append(len(words))
                ids += [get(w, 0) for w in words]
                ids.append(0)  # no string crosses from one text to the next
                at += 1
            flat = np.array(ids, np.int32)
            starts = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for searcher in self.searchers:
                for place, found in searcher.find(flat):
                    doc = int(np.searchsorted(starts, place, side="right")) - 1
                    begin = place - int(starts[doc])
                    spans.setdefault(doc, []).append((begin, begin + searcher.m))
                    items.setdefault(doc, set()).update(self.items_at(found))
            for doc, n in enumerate(sizes):
                yield n, merged(spans.get(doc, [])), items.get(doc, set())


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint spans as starts and ends in turn."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def benchmark_shares(benchmark: DataFrame, bound: int) -> tuple[int, Iterator[list[tuple[str | None, bytes]]]]:
    """The number of shares of about `bound` bytes, and the items share by share."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shares = total // bound + 1
    pick = lambda k: rows if shares == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(shares)) == k)
    return shares, ([(r.item, (r.text or "").encode()) for r in pick(k).collect()] for k in range(shares))


FOUND = "n_words long, spans array<long>, items array<string>"


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, bound: int = BENCHMARK_BYTES) -> DataFrame:
    """The rows of docs with n_words, spans (word starts and ends in turn) and items (sorted distinct item ids)."""
    shares, items = benchmark_shares(benchmark, bound)
    if shares == 1:
        return passed(docs, next(items), window)
    folder = work_dir(docs.sparkSession, "decontaminate")
    rows = stored(docs.withColumn("marked_row", F.monotonically_increasing_id()), folder, "rows")
    texts, passes = rows.select("marked_row", "text"), []
    for k, share in enumerate(items):
        found = passed(texts, share, window).drop("text")
        passes.append(stored(found if k == 0 else found.where("size(items) > 0 or size(spans) > 0"), folder, f"pass-{k}"))
    both = reduce(DataFrame.union, passes).groupBy("marked_row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")
    )
    whole = both.mapInArrow(put_together, f"marked_row long, {FOUND}")
    return rows.join(whole, "marked_row").select(*docs.columns, "n_words", "spans", "items")


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items of several passes as those of one."""
    for batch in batches:
        spans = [merged(list(zip(x[::2], x[1::2], strict=True))) for x in batch.column(2).to_pylist()]
        items = [sorted(set(x)) for x in batch.column(3).to_pylist()]
        arrays = [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)


def passed(docs: DataFrame, share: list[tuple[str | None, bytes]], window: int) -> DataFrame:
    """One pass: the rows of docs, then FOUND."""
    text, width = docs.columns.index("text"), len(docs.columns)
    name = hashlib.sha256(repr((window, share)).encode()).hexdigest()
    names = [*docs.columns, "n_words", "spans", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("decontamination", _searchers.clear)
        if name not in _searchers:
            _searchers.clear()
            _searchers[name] = Search(share, window)
        search = _searchers[name]
        for batch in batches:
            found = list(search.scan(as_bytes(batch.column(text))))
            arrays = [batch.column(i) for i in range(width)]
            arrays += [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))]
            arrays.append(pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(arrays, names)
        release()

    schema = docs.select("*", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("array<long>").alias("spans"), F.lit(None).cast("array<string>").alias("items")).schema
    return docs.mapInArrow(run, schema)


def n_hit():
    """Words inside the spans: ends minus starts."""
    return F.aggregate(
        F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x
    )


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    found = marked(rows, benchmark).withColumn("n_hit", n_hit())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that no benchmark window occurs in."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" if c != "text" else "text" for i, c in enumerate(names)])
    return marked(plain, benchmark).where(F.size("spans") == 0).drop("n_words", "spans", "items").toDF(*names)


ORACLE = r"""
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pats AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
starts AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM fold CROSS JOIN (SELECT DISTINCT m FROM pats))),
found AS (SELECT doc_id, m, i, item_id FROM starts JOIN pats USING (m, g)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l
  FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM fold LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""
