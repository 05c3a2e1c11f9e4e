"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, read back by memory mapping.

A part is three files: ``.ids`` (all ids, little-endian, 2 bytes each where the vocabulary allows, else 4),
``.off`` (n + 1 offsets into it, little-endian 64-bit, counted in ids) and ``.doc`` (n document ids, 64-bit).
Documents stand in ascending doc_id order over all parts. A part's base (the ids in all parts before it) is the
prefix sum over the manifest, so no task needs to know more than its own part. There is a part for every `PART_BYTES`
of text; a doc_id, or no doc_id, that very many rows share is cut into several parts like any other range. Reading
takes a part in pieces of `PIECE_DOCS` documents.

Defined results: null and empty texts give the end id alone; repeated rows are all written, equal doc_ids in the
order of the first 64 characters of their texts, then of a hash of these; rows without doc_id come first and are read back with a null doc_id; an empty table gives no
parts and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import as_bytes, only, open_fs, release, shuffle_partitions, stored, take_turn, work_dir

#: Words that a worker remembers, their characters at most, and bytes of text that it takes at once: memory alone, ids are the same without.
CACHED_WORDS = 400_000
SHORT = 32
RUN_BYTES = 8_000_000
#: Bytes of text in a part, and documents of a part read at once.
PART_BYTES = 256_000_000
PIECE_DOCS = 20_000
NO_ID = -(2**63)
_encoders: dict[str, "WordEncoder"] = {}


def visible_bytes() -> dict[int, str]:
    """The character that byte-level BPE files write for each byte: itself where printable, else the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordEncoder:
    """Encodes runs of texts by their pieces between ASCII white space, and each distinct word of these once.

    Sound where the tokenizer drops white space and never looks across it, as the normalizer and the
    pre-tokenizer of the word-end BPE files do; checked on opening, else whole texts are encoded. Pieces of plain
    Latin letters, digits and signs are cut into words, and each new word goes to the library's BPE model; all other
    pieces go through its whole encoder. Arrow splits texts and pieces, numbers what is distinct and joins the ids.
    """

    #: The capital I with a dot is two characters in lower case.
    ODD = "[^\x21-\x7e\xa1-\u012f\u0131-\u024f]"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u4" if vocabulary > 0xFFFF else "<u2")
        normal = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        added = [x["content"] for x in spec.get("added_tokens", [])]
        self.by_piece = (
            normal == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in before] == ["Split", "ByteLevel"]
            and before[0].get("behavior") == "Removed"
            and not before[1].get("add_prefix_space")
            and not any(c in x for x in added for c in " \t\n\v\f\r")
        )
        if self.by_piece:
            self.words = before[0]["pattern"]["Regex"]
            try:
                pc.match_substring_regex(pa.array([""]), self.words)
            except pa.ArrowInvalid:  # a pattern that Arrow has no such matches for
                self.by_piece = False
        self.odd = "|".join([self.ODD, *map(re.escape, added)])
        self.visible = visible_bytes()
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def packed(self, ids) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def word(self, word: str) -> bytes:
        """One word of the pre-tokenizer, in lower case."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.visible)
        width = self.dtype.itemsize
        return b"".join([t.id.to_bytes(width, "little") for t in self.model.tokenize(shown)])

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, packed."""
        if not self.by_piece:
            yield from (self.packed(self.ids(t.decode())) for t in texts)
            return
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= RUN_BYTES:
                yield from self.run(held)
                held, size = [], 0
        if held:
            yield from self.run(held)

    def run(self, texts: list[bytes]) -> list[bytes]:
        whole = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        return put_together(pc.ascii_split_whitespace(whole), self.pieces).to_numpy(zero_copy_only=False).tolist()

    def pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of each piece, packed."""
        odd = pc.match_substring_regex(pieces, self.odd)
        plain = pc.utf8_lower(pc.if_else(odd, "", pieces))
        spaced = pc.replace_substring_regex(plain, self.words, r"\0 ")
        ids = put_together(pc.ascii_split_whitespace(spaced), lambda words: self.remembered(words, self.word))
        return pc.replace_with_mask(ids, odd, self.remembered(pieces.filter(odd), lambda piece: self.packed(self.ids(piece))))

    def remembered(self, keys: pa.Array, make: Callable[[str], bytes]) -> pa.Array:
        known, keys = self.known, keys.to_numpy(zero_copy_only=False).tolist()
        if len(known) > CACHED_WORDS:  # what is not asked for now goes
            known = self.known = {k: known[k] for k in keys if k in known}
        found = []
        for k in keys:
            if (ids := known.get(k)) is None:
                ids = make(k)
                if len(k) <= SHORT:
                    known[k] = ids
            found.append(ids)
        return pa.array(found, pa.large_binary())


def put_together(lists: pa.Array, ids_of: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """The ids of each list of strings, which are looked up once for each distinct string."""
    numbered = lists.flatten().dictionary_encode()
    ids = ids_of(numbered.dictionary).take(numbered.indices)
    return pc.binary_join(type(lists).from_arrays(lists.offsets, ids), pa.scalar(b"", pa.large_binary()))


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_parts(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Write the files; returns the manifest: part, path, n_docs, n_ids, width. One row a part.

    Every attempt of a task writes under a name of its own and the manifest names the one that ended well, so a
    lost executor leaves at most an unreferenced file.
    """
    rows = only(docs)
    if parts is None:
        total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        parts = max(shuffle_partitions(docs.sparkSession), total // PART_BYTES)
    order = ["doc_id", "lead", "digest"]
    rows = rows.select("*", F.substring("text", 1, 64).alias("lead"), F.xxhash64("text").alias("digest"))
    rows = rows.withColumn("spread", F.monotonically_increasing_id())  # rows that agree in all else can change places
    ordered = rows.repartitionByRange(parts, *order, "spread").sortWithinPartitions(*order, "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("token files", _encoders.clear)
        fs, top = open_fs(folder)
        task = TaskContext.get()
        part, stem = task.partitionId(), f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        coder, ids, out = encoder(tokenizer_path), [], None
        sizes: list[np.ndarray] = []
        end = coder.packed([end_id])
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(top, recursive=True)
                out = fs.open_output_stream(f"{stem}.ids")
            own = []
            for packed in coder.encode(as_bytes(batch.column(1))):
                out.write(packed + end)
                own.append(len(packed) // coder.dtype.itemsize + 1)
            sizes.append(np.array(own, np.int64))
            ids.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        release()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        for kind, what in (("off", offsets.astype("<u8")), ("doc", np.concatenate(ids).astype("<i8"))):
            with fs.open_output_stream(f"{stem}.{kind}") as f:
                f.write(what.tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "path": stem, "n_docs": len(offsets) - 1, "n_ids": int(offsets[-1]), "width": coder.dtype.itemsize}]
        )

    return ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long, width long")


def with_bases(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Prefix sums over the manifest, which has one row a part (never a row a document)."""
    rows = manifest.orderBy("part").collect()
    bases = [0, *accumulate(r.n_ids for r in rows)]
    schema = "part long, path string, n_docs long, n_ids long, width long, base long"
    return spark.createDataFrame([(*r, b) for r, b in zip(rows, bases, strict=False)], schema)


def mapped(fs, path: str, dtype: str, begin: int, end: int) -> np.ndarray:
    """Entries begin to end of a file: mapped where the file system can do so, else those bytes read."""
    size = np.dtype(dtype).itemsize
    if begin >= end:
        return np.empty(0, dtype)
    if fs.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r", offset=begin * size, shape=(end - begin,))
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_at((end - begin) * size, begin * size), dtype=dtype)


def read_parts(bases: DataFrame, folder: str) -> DataFrame:
    """Read files back: per document doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            for at in range(0, row["n_docs"], PIECE_DOCS):
                end = min(row["n_docs"], at + PIECE_DOCS)
                cut = mapped(fs, f"{row['path']}.off", "<u8", at, end + 1).astype(np.int64)
                docs = np.array(mapped(fs, f"{row['path']}.doc", "<i8", at, end))
                first = int(cut[0])
                ids = mapped(fs, f"{row['path']}.ids", f"<u{row['width']}", first, int(cut[-1]))
                crc = [zlib.crc32(ids[a - first : b - first].astype("<u4")) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64(), mask=docs == NO_ID),
                        pa.array(cut[:-1] + row["base"], pa.int64()),
                        pa.array(np.diff(cut), pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    parts = max(1, min(shuffle_partitions(bases.sparkSession), 2000))
    return bases.repartition(parts, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write documents as token files below `folder` and return what the files hold of each document."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "tokens")
    manifest = stored(write_parts(docs, f"{folder}/files", tokenizer_path, end_id), folder, "manifest")
    return read_parts(with_bases(spark, manifest), f"{folder}/files")
