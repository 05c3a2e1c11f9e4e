"""WARC: write archives, read them back by boundary-chain verification.

Writing: payloads of at least `DEDUP_BYTES` bytes that are equal are stored once, as a response record of the row with
the largest page_id; the others become revisit records that refer to it. Tasks write uncompressed WARC/1.1 files of
about `FILE_BYTES` each, under names of their own attempt, and report them in a manifest.

Reading: files are cut into splits of `SPLIT_BYTES`. A task looks for the record magic in its split, reads each
candidate's header, no payload, and emits the candidate's offset and its successor's, as the header's length says. Payloads can
hold the magic, so a candidate proves nothing: only what the chain of successors from the file's start reaches is a
record. Within a split chains are followed at once, to the first offset behind the split; across splits pointer
jumping doubles the distance each round, so a file of n splits needs about log2(n) rounds. A chain that does not end
at its file's end is an error, and so is a payload that does not have its header's digest.

Defined results: null html is an empty payload; a null url is written as an empty one, and line ends in it as
percent codes; rows that repeat the largest page_id of their payload are all responses; a null page_id refers to the
response, and is one itself where no row with that payload has an id; an empty table writes no file and gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import deleted, open_fs, shuffle_partitions, split_join, stored, work_dir

DEDUP_BYTES = 1000
FILE_BYTES = 64_000_000
SPLIT_BYTES = 4_000_000
#: Bytes read behind a split for its last headers; where one is longer, the file is read on to its end.
HEADER_BYTES = 1 << 16
#: Bytes of a payload digested at once.
PAYLOAD_BYTES = 1 << 22
MAGIC = b"WARC/1.1\r\n"
#: Groups of equal payloads that are sent to all tasks at most (28 bytes each); more are met in a shuffled join.
BROADCAST_GROUPS = 500_000
HEADER = re.compile(rb"([A-Za-z][A-Za-z0-9-]*): ([^\r\n]*)\r\n")
#: All whole lines of a header, and what may become one (or the blank line) with more bytes.
LINES = re.compile(rb"(?:[A-Za-z][A-Za-z0-9-]*+: [^\r\n]*+\r\n)*+")
OPEN = re.compile(rb"(?:\r|[A-Za-z][A-Za-z0-9-]*+(?::(?: [^\r\n]*+\r?)?)?)?\Z")


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, size, record_type, refers_to."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.select("*", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("size"))
    large = rows.where(F.col("size") >= DEDUP_BYTES).select("digest", "page_id")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("digest", "last")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(groups), "digest", "left") if few else split_join(rows, groups, ["digest"], "left")
    revisit = F.col("last").isNotNull() & (F.coalesce(F.col("page_id") < F.col("last"), F.lit(True)))
    return joined.select(
        "page_id", "url", "html", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("last")).alias("refers_to"),
    )


def record(kind: str, fields: list[tuple[str, object]], payload: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", len(payload))] if v is not None)
    return MAGIC + head.encode("utf-8", "surrogatepass") + b"\r\n" + payload + b"\r\n\r\n"


def page_record(r: dict) -> bytes:
    url = (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Record-ID", f"<urn:page:{r['page_id']}>"), ("WARC-Target-URI", url), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("X-Page-Id", r["page_id"]), ("X-Payload-Length", r["size"]),
        ("X-Refers-To", r["refers_to"]), ("WARC-Refers-To", r["refers_to"] and f"<urn:page:{r['refers_to']}>"),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    return record(r["record_type"], fields, r["html"] if r["record_type"] == "response" else b"")


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write files; returns the manifest: file, size, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        task = TaskContext.get()
        out, name, serial, size, records = None, "", 0, 0, 0

        def manifest():
            return pa.RecordBatch.from_pylist([{"file": name, "size": size, "records": records}])

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(top, recursive=True)
                    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{serial:04d}.warc"
                    out = fs.open_output_stream(f"{top}/{name}")
                    first = record("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>")], b"format: WARC File Format 1.1\r\n")
                    out.write(first)
                    size, records, serial = len(first), 0, serial + 1
                raw = page_record(r)
                out.write(raw)
                size, records = size + len(raw), records + 1
                if size >= file_bytes:
                    out.close()
                    yield manifest()
                    out = None
        if out is not None:
            out.close()
            yield manifest()

    return with_record_types(pages).mapInArrow(run, "file string, size long, records long")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
CANDIDATES = "file string, split long, size long, offsets array<long>, successors array<long>, exits array<long>"
CANDIDATE_SCHEMA = pa.schema(
    [("file", pa.string()), ("split", pa.int64()), ("size", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("offsets", "successors", "exits"))]
)


def header_at(raw: bytes, at: int, stop: int) -> tuple[dict[bytes, bytes], int] | None:
    """Fields and end of the header at this place, whose lines end at `stop`; None where there is no whole header."""
    if raw[stop : stop + 2] != b"\r\n":
        return None
    fields = dict(HEADER.findall(raw, at + len(MAGIC), stop))
    if not fields.get(b"Content-Length", b"").isdigit() or b"WARC-Type" not in fields:
        return None
    return fields, stop + 2


def header_in(file, raw: bytes, begin: int, at: int, size: int) -> tuple[bytes, tuple[dict[bytes, bytes], int] | None]:
    """What `header_at` finds at a place of `raw`, which starts at `begin` of the file and is read on while lines go on."""
    stop, more = LINES.match(raw, at + len(MAGIC)).end(), HEADER_BYTES
    while begin + len(raw) < size and OPEN.match(raw, stop):
        file.seek(begin + len(raw))
        raw += file.read(min(more, size - begin - len(raw)))
        stop, more = LINES.match(raw, stop).end(), 2 * more
    return raw, header_at(raw, at, stop)


def split_candidates(file, size: int, begin: int, end: int) -> tuple[list[int], list[int]]:
    """Offsets and successors of all places that look like a record; payloads are not read on."""
    file.seek(begin)
    raw = file.read(min(size, end + HEADER_BYTES) - begin)
    offsets, successors = [], []
    at = raw.find(MAGIC)
    while 0 <= at < end - begin:
        raw, found = header_in(file, raw, begin, at, size)
        if found:
            successor = begin + found[1] + int(found[0][b"Content-Length"]) + 4
            if successor <= size:
                offsets.append(begin + at)
                successors.append(successor)
        at = raw.find(MAGIC, at + 1)
    return offsets, successors


def page_of(file, at: int, successor: int, size: int) -> dict | None:
    """The record at an offset that the chain reaches; None for records that are no page. A payload must have its digest."""
    file.seek(at)
    raw, found = header_in(file, file.read(min(HEADER_BYTES, successor - at)), at, 0, size)
    if found is None:
        raise ValueError(f"no header at {at}")
    fields, start = found
    kind = fields[b"WARC-Type"].decode("utf-8", "replace")
    if kind not in ("response", "revisit"):
        return None
    number = lambda k: int(v) if re.fullmatch(rb"-?\d{1,19}", v := fields.get(k, b"")) else None
    digest, n = fields.get(b"WARC-Payload-Digest", b"").decode("utf-8", "replace").removeprefix("sha1:"), number(b"X-Payload-Length")
    if kind == "response":
        n = int(fields[b"Content-Length"])
        told, seen = digest, hashlib.sha1(raw[start : start + n])
        left = n - max(0, len(raw) - start)
        if left > 0:
            file.seek(at + len(raw))
        while left > 0:
            part = file.read(min(left, PAYLOAD_BYTES))
            if not part:
                break
            seen.update(part)
            left -= len(part)
        digest = seen.hexdigest()
        if told != digest:
            raise ValueError(f"the payload at {at} does not have its digest")
    return {"page_id": number(b"X-Page-Id"), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": number(b"X-Refers-To")}


def find_candidates(folder: str, split_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        for r in (r for b in batches for r in b.to_pylist()):
            begin, end = r["split"] * split_bytes, min(r["size"], (r["split"] + 1) * split_bytes)
            with fs.open_input_file(f"{top}/{r['file']}") as f:
                offsets, successors = split_candidates(f, r["size"], begin, end)
            place = {o: i for i, o in enumerate(offsets)}
            exits = list(successors)
            for i in range(len(offsets) - 1, -1, -1):  # from the back: a successor's exit is known
                nxt = successors[i]
                if nxt < end:
                    exits[i] = exits[place[nxt]] if nxt in place else -1
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t.type) for v, t in zip((r["file"], r["split"], r["size"], offsets, successors, exits), CANDIDATE_SCHEMA, strict=True)],
                schema=CANDIDATE_SCHEMA,
            )

    return run


def chain_entries(candidates: DataFrame, folder: str) -> DataFrame:
    """(file, offset) where the chain of each file enters a split, by pointer jumping from offset 0."""
    jumps = candidates.select("file", F.explode(F.arrays_zip("offsets", "exits")).alias("j"))
    jumps = stored(jumps.select("file", F.col("j.offsets").alias("at"), F.col("j.exits").alias("to")), folder, "jumps-0")
    reached = candidates.select("file", F.lit(0).cast("long").alias("at")).distinct()
    known, k = reached.count(), 0
    while True:
        step = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        k += 1
        reached = stored(reached.union(step).distinct(), folder, f"reached-{k}")
        now = reached.count()
        deleted(candidates.sparkSession, folder, f"reached-{k - 1}")
        if now == known:
            return reached
        known = now
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        jumps = jumps.join(onward, ["file", "to"], "left").select("file", "at", F.coalesce("further", "to").alias("to"))
        jumps = stored(jumps, folder, f"jumps-{k}")
        deleted(candidates.sparkSession, folder, f"jumps-{k - 1}")


def reachable(folder: str):
    """Rows of candidates with the split's entry: the records on the chain, whose payloads are read and digested here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        for batch in batches:
            for r in batch.to_pylist():
                following = dict(zip(r["offsets"], r["successors"], strict=True))
                out, at = [], r["entry"]
                with fs.open_input_file(f"{top}/{r['file']}") as f:
                    while at in following:
                        if page := page_of(f, at, following[at], r["size"]):
                            out.append(page)
                        at = following[at]
                yield pa.RecordBatch.from_pylist(out, RECORD_SCHEMA)

    return run


def read_archives(manifest: DataFrame, archives: str, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The page records of the files in a manifest (file, size), below `archives`."""
    splits = manifest.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("size") - 1) / split_bytes).cast("long"))).alias("split"))
    parts = max(2, shuffle_partitions(manifest.sparkSession))
    found = splits.select("file", "split", "size").repartition(parts, "file", "split").mapInArrow(find_candidates(archives, split_bytes), CANDIDATES)
    candidates = stored(found, folder, "candidates")
    reached = chain_entries(candidates.select("file", "size", "offsets", "exits"), folder)
    ends = reached.join(manifest.select("file", "size"), "file").where(F.col("at") == F.col("size")).select("file").distinct()
    broken = manifest.select("file").join(ends, "file", "left_anti").limit(5).collect()
    if broken:
        raise ValueError(f"no chain of records reaches the end of {', '.join(r.file for r in broken)}")
    entries = reached.select("file", (F.col("at") / split_bytes).cast("long").alias("split"), F.col("at").alias("entry"))
    entries = entries.groupBy("file", "split").agg(F.min("entry").alias("entry"))
    return candidates.join(entries, ["file", "split"]).select("file", "size", "entry", "offsets", "successors").mapInArrow(reachable(archives), RECORDS)


def warc_round_trip(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write pages as WARC files and return what reading them back gives."""
    folder = folder or work_dir(pages.sparkSession, "warc")
    manifest = stored(write_archives(pages, f"{folder}/files", file_bytes), folder, "manifest")
    return read_archives(manifest, f"{folder}/files", folder, split_bytes)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM d
"""
