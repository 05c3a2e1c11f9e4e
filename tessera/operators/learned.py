"""Dense vectors learned from the texts themselves: co-occurrence counts, a randomised range finder, documents as weighted sums.

Words that stand within `WINDOW` words of each other are counted, and counts become positive pointwise mutual information, a symmetric
sparse matrix. Its range is found by multiplying it with random signs, made from a hash of the column, and some rounds more of multiplication
with the result made orthonormal in between; what the driver sees are square matrices of `dim + SPARE` columns. The small projected matrix is
decomposed there; words get their rows of its leading vectors, weighted by the roots of the eigenvalues. A document is the sum of its words'
vectors, rare words weighing more, brought to length 1.

A known word is a number, its place among the hashes of all known words, and `BLOCK` numbers are a block. Tasks count the pairs that they see and shuffle
them by pair of blocks, sorted, as packed differences; the matrix is kept in that form, one triangle of it. In a product, the pieces of a block's rows are
shuffled to one task, which reads the other factor block by block from its written table; sums over a document's words are made
in the same way, so no row is shuffled with a vector on it. A worker holds 24 bytes for each known word, the pieces of a few blocks, and a block of vectors.

Words that fewer than `LEAST` documents hold have no vector.

Defined results: words are those of `embedding.terms` (no stop words, a plural s dropped); texts without a known word, null and empty ones have a zero vector;
each row of a table gets a vector, repeated ids too. Vocabularies with fewer words than `dim` give vectors with zeros behind. Signs are
fixed by the largest entry, so results do not depend on how tables are dealt out, up to rounding.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.files import files_below, open_fs
from tessera.operators.embedding import terms
from tessera.tables import deleted, freed, stored, work_dir

DIM, SPARE = 64, 8
#: Words to each side that count as near, documents that a word must occur in, rounds of multiplication.
WINDOW, LEAST, ROUNDS = 4, 3, 3
#: The weight of a word with the share p of all words is RARE / (RARE + p).
RARE = 1e-3
#: Words of a block are 1 << BITS.
BITS = 13
BLOCK = 1 << BITS
#: Words, pairs and documents that a task takes together, and entries that it multiplies at once.
WORDS, PAIRS, DOCS, ENTRIES = 2_000_000, 8_000_000, 50_000, 2048
#: Tasks of a product, where there are as many blocks; with more than four times as many blocks a task has four.
TASKS = 64


def batches_of(uri: str, columns: list[str], rows: int = 65536) -> Iterator[pa.RecordBatch]:
    """A written table, read beside a task's own rows."""
    fs, _ = open_fs(uri)
    for path, _ in files_below(uri, ".parquet"):
        with fs.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(rows, columns=columns)


@lru_cache(1)
def vocabulary(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the known words in order, occurrences)."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches_of(uri, ["i", "n"])]
    ids, n = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(2))
    order = np.argsort(ids)
    return ids[order], n[order]


@lru_cache(1)
def row_sums(uri: str, size: int) -> np.ndarray:
    out = np.zeros(size)
    for b in batches_of(uri, ["code", "r"]):
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the entries of lists, the list of each)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their counts. Without counts, keys are sorted in place."""
    if counts is None:
        keys.sort()
        at = starts(keys)
        return keys[at], np.diff(np.r_[at, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = starts(keys)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Places in order and their counts: differences, byte by byte, compressed."""
    planes = [np.diff(keys, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()]
    return pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, 12 * n, "zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.int64), np.ascontiguousarray(raw[4 * n :].reshape(8, n).T).view("<u8").ravel().astype(np.int64)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """i, docs, n: hashes, the documents that hold them and their occurrences, for some documents together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    docs = size = 0

    def out() -> pa.RecordBatch:
        words, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        pairs, n = summed(at * docs + np.concatenate([d for _, d in held]))
        first = starts(pairs // max(docs, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (words, np.diff(np.r_[first, len(pairs)]), np.add.reduceat(n, first) if len(first) else n)], ["i", "docs", "n"])

    for b in batches:
        h, d = flat(b.column(0))
        held.append((h, d + docs))
        docs, size = docs + b.num_rows, size + len(h)
        if size >= WORDS:
            yield out()
            held, docs, size = [], 0, 0
    if size:
        yield out()


def counts_of(codes: DataFrame, size: int, window: int) -> DataFrame:
    """own, other (blocks, own <= other), n, data: the counts of near words, each pair once, packed. codes: rows with the numbers of known words, else -1."""

    def pieces(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        cells = keys >> (2 * BITS)
        cuts = np.r_[starts(cells), len(keys)]
        rows = [(int(cells[a]), int(b - a), packed(keys[a:b] & (BLOCK * BLOCK - 1), counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in range(0, len(rows), 64):
            cell, n, data = zip(*rows[k : k + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["cell", "n", "data"])

    across = -(-size // BLOCK)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0
        for b in batches:
            code, doc = flat(b.column(0))
            code = code.astype(np.int64)
            for step in range(1, window + 1):
                one, two = code[:-step], code[step:]
                near = (one >= 0) & (two >= 0) & (doc[:-step] == doc[step:])
                low, high = np.minimum(one, two)[near], np.maximum(one, two)[near]
                held.append((((low >> BITS) * across + (high >> BITS)) << (2 * BITS)) | ((low & (BLOCK - 1)) << BITS) | (high & (BLOCK - 1)))
                total += len(low)
            if total >= PAIRS:
                yield from pieces(*summed(np.concatenate(held)))
                held, total = [], 0
        if total:
            yield from pieces(*summed(np.concatenate(held)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, total = None, [], 0

        def whole() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])) if len(held) > 1 else held[0]

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = whole()
            data = [pa.array([x], kind) for x, kind in ((cell // across, pa.int64()), (cell % across, pa.int64()), (len(keys), pa.int64()), (packed(keys, counts), pa.binary()))]
            yield pa.RecordBatch.from_arrays(data, ["own", "other", "n", "data"])

        for b in batches:
            for at, n, data in zip(*(b.column(c).to_pylist() for c in ("cell", "n", "data")), strict=True):
                if at != cell:
                    if held:
                        yield from out()
                    cell, held, total = at, [], 0
                held.append(unpacked(data, n))
                total += n
                if total >= PAIRS and total > 2 * len(held[0][0]):
                    held = [whole()]
                    total = len(held[0][0])
        if held:
            yield from out()

    cells = codes.mapInArrow(seen, "cell long, n long, data binary").repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(merged, "own long, other long, n long, data binary")


def sums_of(counts: DataFrame, size: int) -> DataFrame:
    """code, r: the sums of the symmetric matrix's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for own, other, n, data in zip(*(b.column(c).to_pylist() for c in ("own", "other", "n", "data")), strict=True):
                keys, c = unpacked(data, n)
                for block, places in ((own, keys >> BITS), (other, keys & (BLOCK - 1))):
                    found = np.bincount(places, c)
                    total[block * BLOCK : block * BLOCK + len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "r"])

    return counts.mapInArrow(run, "code long, r double").groupBy("code").agg(F.sum("r").alias("r"))


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def signs(ids: np.ndarray, k: int) -> np.ndarray:
    """1 where Spark's xxhash64 of (id, column) is even, else -1."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = (np.uint64(42) + p5 + np.uint64(8)) ^ (rotated(ids.view(np.uint64) * p2, 31) * p1)
        h = mixed(rotated(h, 27) * p1 + p4)[:, None]
        h = (h + p5 + np.uint64(4)) ^ (np.arange(k, dtype=np.uint64) * p1)[None, :]
        h = mixed(rotated(h, 23) * p2 + p3)
    return np.where(h & np.uint64(1), -1.0, 1.0)


def vectors_of(uri: str, by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(block, rows times a small matrix) of a written product."""
    for b in batches_of(uri, ["block", "y"], 1):
        for block, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield block, np.frombuffer(y).reshape(-1, by.shape[0]) @ by


def added(out: np.ndarray, rows: np.ndarray, cols: np.ndarray, m: np.ndarray, right: np.ndarray) -> None:
    """out += the matrix of entries m times right. rows are in order."""
    room = np.empty((min(ENTRIES, len(rows)), right.shape[1]))
    for k in range(0, len(rows), ENTRIES):
        own = rows[k : k + ENTRIES]
        x = room[: len(own)]
        np.take(right, cols[k : k + ENTRIES], axis=0, out=x, mode="clip")
        x *= m[k : k + ENTRIES, None]
        at = starts(own)
        out[own[at]] += np.add.reduceat(x, at, axis=0)


def multiplied(counts: DataFrame, words: str, sums: str, size: int, total: float, right: str | None, by: np.ndarray, last: bool) -> DataFrame:
    """block, y (rows of float64; empty in the last round), own (y'y), cross (q'y): the matrix times q, the written table `right` times `by`, or else random signs."""
    k = by.shape[1]
    across = -(-size // BLOCK)
    swapped = counts.select(F.col("other").alias("own"), F.col("own").alias("other"), F.lit(True).alias("turned"), "n", "data")
    pieces = counts.select("own", "other", F.lit(False).alias("turned"), "n", "data").union(swapped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for b in batches:
            for own, other, *piece in zip(*(b.column(c).to_pylist() for c in ("own", "other", "turned", "n", "data")), strict=True):
                held[other].append((own, *piece))
        r = row_sums(sums, size)
        out = {own: np.zeros((min(BLOCK, size - own * BLOCK), k)) for own in {p[0] for x in held.values() for p in x}}
        kept = {}
        ids = vocabulary(words)[0]
        blocks = vectors_of(right, by) if right else ((j, signs(ids[j * BLOCK : (j + 1) * BLOCK], k)) for j in list(held))
        for j, q in blocks if held else ():
            if j in out:
                kept[j] = q if last else None
            for own, turned, n, data in held.pop(j, ()):
                keys, c = unpacked(data, n)
                a, b = keys >> BITS, keys & (BLOCK - 1)
                low, high = (j, own) if turned else (own, j)
                twice = (a == b) & (low == high)
                m = np.log(np.where(twice, 2 * c, c) * total / (r[low * BLOCK + a] * r[high * BLOCK + b]))
                keep = (m > 0) & ~(twice & turned)
                rows, cols, m = (b, a, m) if turned else (a, b, m)
                rows, cols, m = rows[keep], cols[keep], m[keep]
                if turned:
                    order = np.argsort(rows.astype(np.uint16), kind="stable")
                    rows, cols, m = rows[order], cols[order], m[order]
                added(out[own], rows, cols, m, q)
        for own, y in out.items():
            cross = kept[own].T @ y if last and own in kept else np.zeros((k, k))
            row = [own, b"" if last else y.tobytes(), (y.T @ y).tobytes(), cross.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, (pa.int64(), *[pa.binary()] * 3), strict=True)], ["block", "y", "own", "cross"])

    return pieces.repartition(max(1, min(across, TASKS), across // 4), "own").mapInArrow(run, "block long, y binary, own binary, cross binary")


def total_of(rows: DataFrame, column: str, k: int) -> np.ndarray:
    """The sum of square matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, k))
        for b in batches:
            for x in b.column(0).to_pylist():
                out += np.frombuffer(x).reshape(k, k)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["s"])

    return sum((np.frombuffer(r.s).reshape(k, k) for r in rows.select(column).mapInArrow(run, "s binary").collect()), np.zeros((k, k)))  # k * k numbers a task


def orthonormal(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes the columns orthonormal: directions without length go."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > max(values.max(initial=0.0), 0.0) * 1e-12
    return vectors[:, keep] / np.sqrt(values[keep])


def signed(rows: DataFrame, words: str, by: np.ndarray) -> np.ndarray:
    """by, with its columns' signs such that the largest entry of rows times by is positive; of equal ones that of the largest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = vocabulary(words)[0]
        for b in batches:
            for block, y in zip(b.column("block").to_pylist(), b.column("y").to_pylist(), strict=True):
                v = np.frombuffer(y).reshape(-1, by.shape[0]) @ by
                own = ids[block * BLOCK : block * BLOCK + len(v)]
                top = [max(zip(np.abs(x), own, x, strict=True)) if len(x) < 2 else max((abs(x[p]), own[p], x[p]) for p in np.flatnonzero(np.abs(x) == np.abs(x).max())) for x in v.T]
                size, i, value = (pa.array([float(t[0]) for t in top]), pa.array([int(t[1]) for t in top]), pa.array([float(t[2]) for t in top]))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(top)), pa.int64()), size, i, value], ["c", "size", "i", "v"])

    tops = rows.select("block", "y").mapInArrow(run, "c long, size double, i long, v double").groupBy("c").agg(F.max_by("v", F.struct("size", "i")).alias("v"))
    by = by.copy()
    for r in tops.collect():  # a row a column
        by[:, r.c] *= 1.0 if r.v >= 0 else -1.0
    return by


def word_vectors(codes: DataFrame, folder: str, size: int, dim: int, window: int) -> tuple[str, np.ndarray]:
    """(a written table, a matrix): the rows of the one times the other are the vectors of the words, as many columns as the matrix has directions, `dim` at most."""
    spark, words, sums = codes.sparkSession, f"{folder}/words", f"{folder}/sums"
    counts = stored(counts_of(codes, size, window), folder, "counts")
    freed(spark)
    total = stored(sums_of(counts, size), folder, "sums").agg(F.sum("r")).first()[0] or 1.0
    y, right, by = None, None, np.eye(dim + SPARE)
    for step in range(ROUNDS + 1):
        before, right = right, y and f"{folder}/y-{step - 1}"
        if y:
            by = orthonormal(total_of(y, "own", by.shape[1]))
            if not by.size:
                return right, by
        rows, y = y, stored(multiplied(counts, words, sums, size, total, right, by, step == ROUNDS), folder, f"y-{step}")
        if before:
            deleted(spark, folder, f"y-{step - 2}")
        freed(spark)
    projected = total_of(y, "cross", by.shape[1])
    values, vectors = np.linalg.eigh((projected + projected.T) / 2)
    order = np.argsort(-values, kind="stable")[:dim]
    order = order[values[order] > values.max() * 1e-9]
    return right, signed(rows, words, by @ (vectors[:, order] * np.sqrt(values[order])))


def learned_vectors(texts: DataFrame, key: str = "doc_id", text: str = "text", dim: int = DIM, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """key, embedding (array<double> of dim entries, of length 1 or zero) for each row."""
    spark = texts.sparkSession
    folder = work_dir(spark, "learned")
    uri = f"{folder}/words"
    hashes = F.coalesce(F.transform(terms(F.col(text)), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))
    said = stored(texts.select(F.col(key).alias("key"), hashes.alias("hs")), folder, "said")
    found = said.select("hs").mapInArrow(counted, "i long, docs long, n long").groupBy("i").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    size, total = stored(found.where(F.col("docs") >= least).select("i", "n"), folder, "words").agg(F.count("*"), F.sum("n")).first()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = vocabulary(uri)[0]
        for b in batches:
            h, d = flat(b.column("hs"))
            at = np.minimum(np.searchsorted(ids, h), max(len(ids) - 1, 0))
            at = np.where(ids[at] == h, at, -1) if len(ids) else np.full(len(h), -1)
            ends = np.r_[0, np.cumsum(np.bincount(d, minlength=b.num_rows))]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))], ["key", "codes"])

    kind = said.schema["key"].dataType.simpleString()
    codes = stored(said.mapInArrow(code, f"key {kind}, codes array<int>"), folder, "codes")
    deleted(spark, folder, "said")
    freed(spark)
    right, by = word_vectors(codes.select("codes"), folder, size, dim, window) if size else ("", np.zeros((0, 0)))
    wide = by.shape[1]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs = said = 0

        def out() -> Iterator[pa.RecordBatch]:
            v = np.zeros((docs, dim))
            code, doc = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            pairs, tf = summed((code.astype(np.int64) * docs + doc)[code >= 0])
            code, doc = np.divmod(pairs, max(docs, 1))
            n = vocabulary(uri)[1]
            sums = np.zeros((docs, wide))
            for block, q in vectors_of(right, by) if wide and len(pairs) else ():
                a, b = np.searchsorted(code, (block * BLOCK, (block + 1) * BLOCK))
                order = np.argsort(doc[a:b], kind="stable") + a
                at = code[order]
                added(sums, doc[order], at - block * BLOCK, tf[order] * (RARE / (RARE + n[at] / total)), q)
            length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            v[:, :wide] = sums / np.where(length == 0, 1.0, length)
            at = 0
            for keys, *_ in held:
                part = v[at : at + len(keys)]
                at += len(keys)
                ends = pa.array(np.arange(len(keys) + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], [key, "embedding"])

        for b in batches:
            code, doc = flat(b.column("codes"))
            held.append((b.column("key"), code, doc + docs))
            docs, said = docs + b.num_rows, said + len(code)
            if docs >= DOCS or said >= PAIRS:
                yield from out()
                held, docs, said = [], 0, 0
        if docs:
            yield from out()

    out = stored(codes.mapInArrow(vectors, f"`{key}` {kind}, embedding array<double>"), folder, "out")
    deleted(spark, folder, "words", "codes", "counts", "sums", *[f"y-{s}" for s in range(ROUNDS + 1)])
    return out
