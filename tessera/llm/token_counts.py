"""Token counts of a byte-pair model with byte fallback: merging by a heap over a linked list, no identifiers.

Symbols are the characters of the normalised text. A heap holds the adjacent pairs that are a piece together; the one of
lowest rank (highest score), leftmost first, is merged again and again, and its new neighbours enter the heap. The count is that
of the first symbols, a character without a piece as its UTF-8 bytes, less one for each merge.

Two neighbouring characters that stand side by side in no piece are never merged over. So a text is cut behind letters that
no piece lets go on with another sign, before signs that follow no other one in a piece (that of a space), and round
characters that no longer piece has; each part is counted on its own. Counts of short parts are remembered, up to `KNOWN` of them a worker. The model's file is read where the tasks run,
once a worker.

Defined results: null counts as empty, and an empty text has no token; an id may be null or repeated, each row is counted by
itself. Models of other kinds, without byte fallback, or with user-defined or unused pieces are an error.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import only

LIMIT = 4096
#: Parts whose counts a worker remembers, and their characters at most: memory alone, counts are the same without.
KNOWN = 400_000
SHORT = 32
#: Places in a part, as a mask: the bits that an entry of the heap has for them.
PLACES = (1 << 32) - 1
#: Fixed values of the model's format: numbers of fields and kinds of pieces.
PIECES, TRAINER = 1, 2
PIECE, SCORE, KIND = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK = 3, 35
BPE = 2
NORMAL, USER_DEFINED, UNUSED = 1, 4, 5
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


def parts(pieces: Collection[str]) -> re.Pattern[str]:
    """Finds the parts of a text, all of it, that no piece spans."""
    pairs = {pair for p in pieces for pair in pairwise(p)}
    joined = {c for pair in pairs for c in pair}
    letters = {c for c in joined if c.isalpha()}
    letters -= {a for a, b in pairs if a in letters and b not in letters}
    first = joined - letters - {b for a, b in pairs if a != b}
    one_of = lambda chars: f"[{''.join(map(re.escape, sorted(chars)))}]" if chars else "(?!)"
    begin, between, end = map(one_of, (first, joined - letters - first, letters))
    return re.compile(f"{begin}*{between}*{end}+|{begin}+{between}*|{between}+|{one_of(joined).replace('[', '[^', 1) if joined else '(?s:.)'}+")


class Counter:
    """Counts the tokens of texts by one model."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            top = list(fields(f.read()))
        trainer = dict(fields(b"".join(v for k, v in top if k == TRAINER)))
        pieces = [dict(fields(v)) for k, v in top if k == PIECES]
        kinds = {p.get(KIND, NORMAL) for p in pieces}
        if trainer.get(MODEL_TYPE) != BPE or not trainer.get(BYTE_FALLBACK) or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("a byte-pair model with byte fallback and without user-defined or unused pieces is needed")
        self.normalise = sentencepiece.SentencePieceProcessor(model_file=path).normalize
        own = [(p[PIECE].decode(), memoryview(p.get(SCORE, bytes(4))).cast("f")[0]) for p in pieces if p.get(KIND, NORMAL) == NORMAL]
        #: Piece -> rank (equal scores alike, the highest first), at its place in an entry of the heap.
        order = {score: rank for rank, score in enumerate(sorted({score for _, score in own}, reverse=True))}
        self.bits = max(len(piece) for piece, _ in own).bit_length()
        self.ranks = {piece: order[score] << self.bits + PLACES.bit_length() for piece, score in own}
        self.single = {piece for piece, _ in own if len(piece) == 1}
        self.parts = parts(self.ranks)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def extra(self, symbol: str) -> int:
        """Tokens besides the first of a character that is not merged."""
        return 0 if symbol in self.ranks else len(symbol.encode("utf-8", "surrogatepass")) - 1

    def merged(self, part: str) -> int:
        """The tokens of a part: its first symbols less the merges."""
        n = len(part)
        if n == 1:
            return 1 + self.extra(part)
        rank_of, bits, size = self.ranks.get, self.bits, (1 << self.bits) - 1
        extra = {i: self.extra(c) for i, c in enumerate(part)} if not self.single.issuperset(part) else {}
        ends = list(range(1, n + 1))  # of the symbol that begins at a place; 0 where none does any more
        before = list(range(-1, n - 1))  # where the symbol before it begins
        # An entry is one number: rank, place and length of a pair.
        heap = [rank + (i << bits) + 2 for i, rank in enumerate(map(rank_of, map(add, part, part[1:]))) if rank is not None]
        heapify(heap)
        tokens, merges = n + sum(extra.values()), 0
        while heap:
            entry = heappop(heap)
            left = entry >> bits & PLACES
            end = left + (entry & size)
            middle = ends[left]
            if not middle or middle >= end or ends[middle] != end:
                continue  # one of the two has been merged meanwhile
            merges += 1
            ends[left], ends[middle] = end, 0
            if extra:
                merges += extra.pop(left, 0) + extra.pop(middle, 0)
            if end < n:
                before[end] = left
                after = ends[end]
                if (rank := rank_of(part[left:after])) is not None:
                    heappush(heap, rank + (left << bits) + after - left)
            if (first := before[left]) >= 0 and (rank := rank_of(part[first:end])) is not None:
                heappush(heap, rank + (first << bits) + end - first)
        return tokens - merges

    def __call__(self, text: str) -> int:
        known, total = self.known, 0
        for part in self.parts.findall(self.normalise(text)) if text else ():
            found = known.get(part)
            if found is None:
                found = self.older.get(part) or self.merged(part)
                if len(part) <= SHORT:
                    if len(known) >= KNOWN // 2:  # the half that was not asked for lately goes
                        self.known, self.older = known, _ = {}, known
                    known[part] = found
            total += found
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())
            ], [c.split()[0] for c in SCHEMA.split(", ")])

    return only(docs, id_col, text_col).mapInArrow(run, SCHEMA)
