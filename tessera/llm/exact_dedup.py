"""Exact dedup by a log-structured merge index over digests of normalised texts.

Texts are equal when identical after deleting white space (`[\\x20\\x09-\\x0D]`). A task collects its rows in a
memtable: one entry for each distinct text, found by a 64-bit digest and compared byte by byte. When the memtable
holds `MEMTABLE_BYTES` it is flushed as a run: entries sorted by digest (count, best row, least id, members in rows
of at most `MEMBERS`, the normalised bytes) and, for each segment of the digest space, a filter of the run's
32-bit fingerprints. Compaction merges a segment's runs: the filters say which entries can be in several runs, only
these are sorted and compared, and the entry with the least identifier becomes the reference of its digest. Each
other entry of that digest, a hit, must then equal the reference's bytes; those that don't (a collision) get a
reference of their own in a further round. A third of all rows with one text is one entry a run, and its members are
met again in a join that can be split, so no task gathers a group.

Defined results: null counts as empty, and empty or blank texts equal each other; the row that stays has the most
code points in its original text, then the least doc_id (null last), then comes first in the input; exactly one row
of a group has kept = true, repeated rows included; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, only, release, shuffle_partitions, split_join, stored, work_dir

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
MEMTABLE_BYTES = 64_000_000
MEMBERS = 4096
#: Rows of the input for each segment of the digest space, which a task merges at once.
SEGMENT_ROWS = 200_000
#: References that are sent to all tasks at most; more are met in a shuffled join.
BROADCAST_ROWS = 200_000
NO_ID = -(2**63)

RUNS = (
    "run long, digest long, variant int, part int, segment int, sha string, n long, chars long, least_id long, "
    "best struct<chars:long,neg_id:long,neg_run:long,neg_pos:long>, "
    "ids array<long>, places array<long>, body binary, filter binary"
)
BEST = pa.struct([("chars", pa.int64()), ("neg_id", pa.int64()), ("neg_run", pa.int64()), ("neg_pos", pa.int64())])
RUN_SCHEMA = pa.schema(
    [("run", pa.int64()), ("digest", pa.int64()), ("variant", pa.int32()), ("part", pa.int32()), ("segment", pa.int32()),
     ("sha", pa.string()), ("n", pa.int64()), ("chars", pa.int64()), ("least_id", pa.int64()), ("best", BEST),
     ("ids", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("body", pa.binary()), ("filter", pa.binary())]
)


def segment_of(digest: int, segments: int) -> int:
    return ((digest + (1 << 63)) * segments) >> 64


def fingerprint(digests: np.ndarray) -> np.ndarray:
    return ((digests.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype("<u4")


class Memtable:
    def __init__(self, run: int, segments: int, digest_bits: int):
        self.run, self.segments, self.bits = run, segments, digest_bits
        self.entries: dict[int, list[dict]] = {}
        self.bytes = self.rows = 0

    def add(self, doc: int, text: bytes, chars: int) -> None:
        body = text.translate(None, SPACE)
        sha = hashlib.sha256(body)
        digest = int.from_bytes(sha.digest()[:8], "big", signed=True) >> (64 - self.bits)
        variants = self.entries.setdefault(digest, [])
        best = (chars, NO_ID if doc == NO_ID else -doc, -self.run, -self.rows)
        for e in variants:
            if e["body"] == body:  # byte verification of a hit
                e["best"] = max(e["best"], best)
                break
        else:
            e = {"body": body, "sha": sha.hexdigest(), "best": best, "ids": [], "places": []}
            variants.append(e)
            self.bytes += len(body) + 300
        e["ids"].append(doc)
        e["places"].append(self.rows)
        self.bytes += 16
        self.rows += 1

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for digest in sorted(self.entries):
            segment = segment_of(digest << (64 - self.bits), self.segments)
            for variant, e in enumerate(self.entries[digest]):
                ids = [None if i == NO_ID else i for i in e["ids"]]
                least = min((i for i in e["ids"] if i != NO_ID), default=None)
                for part in range(0, len(ids), MEMBERS):
                    rows.append(
                        (self.run, digest, variant, part // MEMBERS, segment, e["sha"], len(ids), e["best"][0], least,
                         dict(zip(BEST.names, e["best"], strict=True)), ids[part : part + MEMBERS],
                         e["places"][part : part + MEMBERS], None if part else e["body"], None)
                    )
                size += len(e["body"])
                if size > 8_000_000:
                    yield batch_of(rows)
                    rows, size = [], 0
        digests = np.array(sorted(self.entries), np.int64)
        own = np.array([segment_of(int(d) << (64 - self.bits), self.segments) for d in digests])
        for s in np.unique(own).tolist():
            rows.append((self.run, None, None, None, s, *[None] * 8, np.sort(fingerprint(digests[own == s])).tobytes()))
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RUN_SCHEMA, strict=True)], schema=RUN_SCHEMA)


def flush_runs(segments: int, digest_bits: int, memtable_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 24
        table = Memtable(serial, segments, digest_bits)
        for batch in batches:
            texts = batch.column(1)
            chars = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            for doc, text, n in zip(batch.column(0).fill_null(NO_ID).to_pylist(), as_bytes(texts), chars, strict=True):
                table.add(doc, text, n)
                if table.bytes >= memtable_bytes:
                    yield from table.flush()
                    serial += 1
                    table = Memtable(serial, segments, digest_bits)
        if table.rows:
            yield from table.flush()
        release()

    return run


HITS = "digest long, run long, variant int, ref_run long, ref_variant int"
HIT_SCHEMA = pa.schema(
    [("digest", pa.int64()), ("run", pa.int64()), ("variant", pa.int32()), ("ref_run", pa.int64()), ("ref_variant", pa.int32())]
)


def compact(table: pa.Table) -> pa.Table:
    """Of a segment's filters and entries: every entry of a digest that has several, with the digest's reference."""
    filters = table.column("filter").drop_null().to_pylist()
    prints = np.sort(np.concatenate([np.frombuffer(f, "<u4") for f in filters])) if filters else np.empty(0, "<u4")
    twice = np.unique(prints[1:][prints[1:] == prints[:-1]])
    entries = table.filter(pc.is_valid(table.column("digest")))
    digests = entries.column("digest").to_numpy()
    variants = entries.column("variant").to_numpy()
    maybe = np.isin(fingerprint(digests.astype(np.int64)), twice) | np.isin(digests, digests[variants > 0])
    merged: dict[int, list[tuple]] = {}
    some = entries.filter(pa.array(maybe))
    for r in some.select(["digest", "run", "variant", "least_id"]).to_pylist():
        least = r["least_id"]
        merged.setdefault(r["digest"], []).append((least is None, least or 0, r["run"], r["variant"]))
    out = []
    for digest, found in merged.items():
        if len(found) > 1:
            ref = min(found)
            out += [(digest, f[2], f[3], ref[2], ref[3]) for f in found]
    columns = zip(*out, strict=True) if out else [[] for _ in HIT_SCHEMA]
    release()
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, HIT_SCHEMA, strict=True)], schema=HIT_SCHEMA)


def merge_index(docs: DataFrame, folder: str, digest_bits: int = 64, memtable_bytes: int = MEMTABLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The flushed runs, and (digest, run, variant, class) of every entry that shares its digest with others."""
    segments = max(shuffle_partitions(docs.sparkSession), docs.count() // SEGMENT_ROWS)
    runs = only(docs).mapInArrow(flush_runs(segments, digest_bits, memtable_bytes), RUNS)
    runs = stored(runs, folder, "runs")
    heads = runs.where("part = 0 or filter is not null")
    keys = heads.select("segment", "digest", "run", "variant", "least_id", "filter")
    hits = stored(keys.groupBy("segment").applyInArrow(compact, HITS), folder, "hits")
    wanted = hits.select("digest").distinct()
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    bodies = runs.where("part = 0").select("digest", "run", "variant", "least_id", "body")
    bodies = bodies.join(F.broadcast(wanted) if few else wanted, "digest", "left_semi")
    left, found, round_ = hits, None, 0
    while True:
        compared = left.join(bodies, ["digest", "run", "variant"])
        refs = left.where("run = ref_run and variant = ref_variant").select("digest", "run", "variant")
        refs = refs.join(bodies.drop("least_id"), ["digest", "run", "variant"]).select("digest", F.col("body").alias("ref_body"))
        compared = split_join(compared, refs, ["digest"]).select("digest", "run", "variant", "least_id", (F.col("body") == F.col("ref_body")).alias("same"))
        compared = stored(compared, folder, f"verified-{round_}")
        same = compared.where("same").select("digest", "run", "variant", F.lit(round_).alias("class"))
        found = same if found is None else found.union(same)
        others = compared.where("not same")
        if others.isEmpty():
            return runs, found
        least = F.min(F.struct(F.col("least_id").isNull(), "least_id", "run", "variant")).alias("r")
        refs = others.groupBy("digest").agg(least).select("digest", F.col("r.run").alias("ref_run"), F.col("r.variant").alias("ref_variant"))
        left = split_join(others.select("digest", "run", "variant"), refs, ["digest"])
        round_ += 1


def exact_duplicates(docs: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    folder = folder or work_dir(docs.sparkSession, "exact-dedup")
    runs, classes = merge_index(docs, folder, **settings)
    members = runs.where("digest is not null").select("run", "digest", "variant", "part", "sha", "n", "best", "ids", "places")
    members = members.join(classes, ["digest", "run", "variant"], "left").withColumn("class", F.coalesce("class", F.lit(0)))
    index = members.where("part = 0").groupBy("digest", "class").agg(F.max("best").alias("top"), F.sum("n").alias("group_size"))
    rows = split_join(members.select("digest", "class", "run", "sha", "ids", "places"), index, ["digest", "class"])
    member = F.explode(F.arrays_zip("ids", "places")).alias("m")
    rows = rows.select("run", "sha", "top", "group_size", member)
    none = F.lit(NO_ID)
    return rows.select(
        F.col("m.ids").alias("doc_id"),
        F.when(F.col("top.neg_id") != none, -F.col("top.neg_id")).alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("run") == -F.col("top.neg_run")) & (F.col("m.places") == -F.col("top.neg_pos"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
"""
