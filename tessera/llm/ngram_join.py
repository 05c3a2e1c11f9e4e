"""N-gram Jaccard join with adaptive multi-match prefixes, to connected components.

Two texts link when the Jaccard similarity of their sets of `WORDS`-word shingles is at least `NUM`/100. Steps:

1. Frequencies. Documents are cut into blocks of about `BLOCK_TOKENS` shingle hashes. A block sends each distinct
   hash once, with its count, to the hash's segment; a segment adds up the document frequency and answers the block
   with the hashes that occur in two documents or more. Only those can be in any intersection, so a document goes
   on only if they make up 75 % of its set. Copies within a block are sent once.
2. Classes. Documents with one and the same set are one class from here on, with a number.
3. Prefixes. Under one global order (frequency, then hash), two linked sets of sizes n share at least l hashes of
   their first n - ceil(0.75 n) + l, for every l. Each class picks the l of 1..`MOST_MATCHES` whose prefix has
   the least estimated cost (postings to scan plus candidates to verify, where candidates fall with l) and pairs
   must share the smaller l of both before they are verified.
4. Centres. Each posting list of a prefix hash has a centre, the class with the fewest hashes of its own. A class is
   verified against the `CENTRES` centres with which it shares most prefix hashes, if it shares enough. The links found
   join most of a group of near copies with about as many comparisons as members.
5. The other pairs. Posting lists are joined with themselves between different components of step 4 only; a list of
   more than `LIST` components is cut into slices that meet in pairs, so that no task holds a whole one.
6. Verification. For each pair of components that shares enough, all members of one are compared with all of the other,
   in chunks of about `CHUNK` members, so no group is gathered and no pair is dropped.

Pairs inside one component need no comparison, as the result is the component; so a group of n near copies costs
about n comparisons and not their square, unless it falls apart.

Defined results: texts that are null, empty or blank have 0 shingles and stand alone; fewer than five words are one
shingle; rows with equal doc_id are judged one by one; a null doc_id is kept as null and never names a component
unless the component has no other; an empty table gives no rows; other columns are ignored. Words have keyed 64-bit
hashes; set sizes and classes are told by 64-bit hashes of shingles, intersections by 48 bits of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, deleted, freed, only, release, shuffle_partitions, split_join, stored, take_turn, work_dir
from tessera.llm.components import components

WORDS = 5
NUM = 75
BLOCK_TOKENS = 1 << 18
BLOCK_DOCS = 30_000
SEGMENT_TOKENS = 600_000
MOST_MATCHES = 8
VERIFY_COST = 4.0
RARE = 32
CENTRES = 3
LIST = 512
CHUNK = 64
#: Words hashed at once, bytes of a long text split at once, and words whose hashes a worker remembers.
PIECE_WORDS, PIECE_BYTES, KNOWN_WORDS = 150_000, 1 << 22, 150_000
KEY = b"shingles of words"
BLANK = re.compile(rb"[\x20\x09-\x0d]")

U = np.uint64
_known: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Keyed 64-bit hashes, each distinct word hashed once as long as it is remembered."""
    try:
        return np.fromiter(map(_known.__getitem__, words), U, len(words))
    except KeyError:
        if len(_known) > KNOWN_WORDS:
            _known.clear()
        for w in words:
            if w not in _known:
                _known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8, key=KEY).digest(), "little")
        return np.fromiter(map(_known.__getitem__, words), U, len(words))


def text_hashes(text: bytes) -> np.ndarray:
    """The hashes of a long text's words, split piece by piece."""
    parts, at = [], 0
    while at < len(text):
        cut = BLANK.search(text, min(len(text), at + PIECE_BYTES))
        end = cut.start() if cut else len(text)
        parts.append(word_hashes(text[at:end].lower().split()))
        at = end + 1
    return np.concatenate(parts) if parts else np.empty(0, U)


def combined(words: np.ndarray, size: int) -> np.ndarray:
    out = np.full(max(0, len(words) - size + 1), size, U)
    for k in range(size):
        out = mixed(out * U(0x9E3779B97F4A7C15) + words[k : k + len(out)])
    return out


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    at = 0
    while at < len(texts):
        parts, words, counts = [], [], []
        total = 0
        while at < len(texts) and total < PIECE_WORDS:
            if len(texts[at]) > PIECE_BYTES:
                parts += [word_hashes(words), text_hashes(texts[at])]
                words = []
                counts.append(len(parts[-1]))
            else:
                own = texts[at].lower().split()
                words += own
                counts.append(len(own))
            total += counts[-1]
            at += 1
        hashes = np.concatenate([*parts, word_hashes(words)])
        whole = combined(hashes, WORDS)
        start = 0
        for n in counts:
            if n >= WORDS:
                yield np.unique(whole[start : start + n - WORDS + 1])
            else:
                yield combined(hashes[start : start + n], n) if n else np.empty(0, U)
            start += n


def pack48(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def needed(n):
    """Least intersection with any set that one of n shingles can link with."""
    return -(-NUM * n // 100)


BLOCKS = "part long, kind int, blk long, a binary, b binary, c binary"
#: kind 0, of a block: a doc ids, b set sizes, c signatures
#: kind 1, of a block: a hashes that occur twice or more in it, b the document of each
#: kind 2, to a segment: a hashes that occur once, b the document of each
#: kind 3, to a segment: a hashes that occur twice or more, b their counts
#: Hashes are sorted and written as steps.
META = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("blk", pa.int64()), *((c, pa.binary()) for c in "abc")])
NO_ID = -(2**63)


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys as the first and the steps between them, in 4 bytes each where these suffice."""
    d = np.diff(keys)
    if len(d) and int(d.max()) >= 1 << 32:
        return b"8" + keys.astype("<u8").tobytes()
    return b"4" + keys[:1].astype("<u8").tobytes() + d.astype("<u4").tobytes()


def from_steps(raw: bytes) -> np.ndarray:
    if raw[:1] == b"8" or len(raw) < 9:
        return np.frombuffer(raw, "<u8", offset=1)
    d = np.frombuffer(raw, "<u4", offset=9)
    out = np.empty(len(d) + 1, U)
    out[0] = np.frombuffer(raw, "<u8", 1, 1)[0]
    np.cumsum(d, dtype=U, out=out[1:])
    out[1:] += out[0]
    return out


def block_rows(blk: int, segments: int, ids: list, sizes: list[int], signs: list[bytes], sets: list[np.ndarray]):
    """The rows of one block, by the kinds above."""
    home = segments + (blk * 0x9E3779B1 >> 7) % segments
    sent: set[bytes] = set()
    fresh = []
    for i, s in enumerate(signs):
        if sizes[i] and s not in sent:
            sent.add(s)
            fresh.append(i)
    yield home, 0, blk, np.array(ids, "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), b"".join(signs)
    if not fresh:
        return
    keys = np.concatenate([sets[i] for i in fresh]) >> U(16)
    owner = np.repeat(np.array(fresh, np.uint16), [len(sets[i]) for i in fresh])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, len(keys)))
    single = np.repeat(count == 1, count)
    yield home, 1, blk, steps(keys[~single]), owner[~single].tobytes(), None
    once, once_owner = keys[single], owner[single]
    many, many_count = keys[starts[count > 1]], count[count > 1]
    edges = (np.arange(1, segments, dtype=object) * (1 << 48) // segments).astype(U)
    a, b = ([0, *np.searchsorted(x, edges).tolist(), len(x)] for x in (once, many))
    for s in range(segments):
        if a[s + 1] > a[s]:
            yield s, 2, blk, steps(once[a[s] : a[s + 1]]), once_owner[a[s] : a[s + 1]].tobytes(), None
        if b[s + 1] > b[s]:
            yield s, 3, blk, steps(many[b[s] : b[s + 1]]), many_count[b[s] : b[s + 1]].astype("<u4").tobytes(), None


def arrow_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def cut_blocks(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("n-gram join", _known.clear)
        serial = TaskContext.get().partitionId() << 24
        ids: list = []
        sizes: list[int] = []
        signs: list[bytes] = []
        sets: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal serial, held
            rows: list[tuple] = []
            for row in block_rows(serial, segments, ids, sizes, signs, sets):
                rows.append(row)
                if len(rows) >= 500:
                    yield arrow_batch(rows, META)
                    rows = []
            if rows:
                yield arrow_batch(rows, META)
            for x in (ids, sizes, signs, sets):
                x.clear()
            serial, held = serial + 1, 0

        for batch in batches:
            doc_ids = batch.column(0).fill_null(NO_ID).to_pylist()
            for doc, found in zip(doc_ids, shingle_sets(as_bytes(batch.column(1))), strict=True):
                ids.append(doc)
                sizes.append(len(found))
                signs.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sets.append(found)
                held += len(found)
                if held >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCS:
                    yield from flush()
        if ids:
            yield from flush()
        release()

    return run


ANSWERS = "blk long, kind int, a binary, b binary, c binary"
ANSWER_SCHEMA = pa.schema([("blk", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abc")])
#: Frequencies from here on are told apart no more; equal ones stand in the order of the hashes.
MOST_FREQUENT = 0xFFFF


def count_segment(table: pa.Table) -> pa.Table:
    """Rows of kinds 0 and 1 pass; those of 2 and 3 are answered: a hashes in two documents or more, b the document
    of each (kind 2), c their frequencies."""
    if not table.num_rows or table.column("kind")[0].as_py() < 2:
        return table.select(ANSWER_SCHEMA.names).cast(ANSWER_SCHEMA)
    rows = table.select(["blk", "kind", "a", "b"]).to_pylist()
    keys = [from_steps(r["a"]) for r in rows]
    counts = [np.ones(len(k), np.uint32) if r["kind"] == 2 else np.frombuffer(r["b"], "<u4") for r, k in zip(rows, keys, strict=True)]
    ends = np.cumsum([len(k) for k in keys])
    flat, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    total = np.add.reduceat(count[order].astype(np.int64), starts)
    df = np.empty(len(flat), np.uint16)
    df[order] = np.repeat(np.minimum(total, MOST_FREQUENT).astype(np.uint16), np.diff(np.append(starts, len(flat))))
    out = []
    for r, k, end in zip(rows, keys, ends.tolist(), strict=True):
        own = df[end - len(k) : end]
        known = own >= 2
        if known.any():
            docs = np.frombuffer(r["b"], "<u2")[known].tobytes() if r["kind"] == 2 else None
            out.append((r["blk"], r["kind"], steps(k[known]), docs, own[known].astype("<u2").tobytes()))
    release()
    return pa.Table.from_batches([arrow_batch(out, ANSWER_SCHEMA)])


DOCS = "doc_id long, n long, sig binary, m int, rare long, matches int, sorted_set binary, prefix array<long>"
DOC_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("m", pa.int32()), ("rare", pa.int64()), ("matches", pa.int32()),
     ("sorted_set", pa.binary()), ("prefix", pa.list_(pa.int64()))]
)


def matches_of(n: int, df: np.ndarray) -> tuple[int, int]:
    """(l, prefix length) with the least estimated cost; df: frequencies of the shared hashes in the global order."""
    spare = len(df) - needed(n)  # shared hashes in the prefix for l = 0
    scanned = np.cumsum(df[: spare + MOST_MATCHES], dtype=np.float64)
    best = (np.inf, 1, spare + 1)
    for l in range(1, min(MOST_MATCHES, needed(n)) + 1):  # noqa: E741
        size = min(spare + l, len(df))
        cost = scanned[size - 1] + VERIFY_COST * max(0.0, scanned[size - 1] - size) / l
        if cost < best[0]:
            best = (cost, l, size)
    return best[1], best[2]


def rare_bits(keys: np.ndarray, df: np.ndarray) -> int:
    """64 bits: those that the hashes in fewer than `RARE` documents fall on.

    A hash is rare in every set that holds it. So each bit that only one of two sets has is a hash that they don't share.
    """
    places = mixed(keys[df < RARE]) >> U(58)
    return int(np.bitwise_or.reduce(U(1) << places, initial=U(0)).astype(np.int64))


def finish_block(table: pa.Table) -> pa.Table:
    """The block's documents; those that may link carry their shared hashes and prefix."""
    by: dict[int, list[dict]] = {0: [], 1: [], 2: [], 3: []}
    for r in table.select(["kind", "a", "b", "c"]).to_pylist():
        by[r["kind"]].append(r)
    head = by[0][0]
    ids, sizes = np.frombuffer(head["a"], "<i8"), np.frombuffer(head["b"], "<u4")
    keys, docs, freq = [np.empty(0, U)], [np.empty(0, np.uint16)], [np.empty(0, np.uint16)]
    for r in by[2]:
        keys.append(from_steps(r["a"]))
        docs.append(np.frombuffer(r["b"], "<u2"))
        freq.append(np.frombuffer(r["c"], "<u2"))
    if by[1]:
        many = np.concatenate([from_steps(r["a"]) for r in by[3]] or [np.empty(0, U)])
        total = np.concatenate([np.frombuffer(r["c"], "<u2") for r in by[3]] or [np.empty(0, np.uint16)])
        order = np.argsort(many)
        for r in by[1]:
            own = from_steps(r["a"])
            keys.append(own)
            docs.append(np.frombuffer(r["b"], "<u2"))
            freq.append(total[order][np.searchsorted(many[order], own)] if len(own) else np.empty(0, np.uint16))
    keys, docs, freq = np.concatenate(keys), np.concatenate(docs), np.concatenate(freq)
    order = np.lexsort((keys, freq, docs))
    keys, docs, freq = keys[order], docs[order], freq[order]
    starts = np.searchsorted(docs, np.arange(len(ids) + 1))
    sig = head["c"]
    out = []
    for i, (doc, n) in enumerate(zip(ids.tolist(), sizes.tolist(), strict=True)):
        a, b = int(starts[i]), int(starts[i + 1])
        row = (None if doc == NO_ID else doc, n, sig[16 * i : 16 * i + 16] if n else None, b - a)
        if n and b - a >= needed(n):
            own = keys[a:b]
            l, size = matches_of(n, freq[a:b])  # noqa: E741
            row += (rare_bits(own, freq[a:b]), l, pack48(np.sort(own)), own[:size].astype(np.int64))
        else:
            row += (None, None, None, None)
        out.append(row)
    found = pa.Table.from_batches([arrow_batch(out, DOC_SCHEMA)])
    release()
    return found


def described(docs: DataFrame, folder: str) -> DataFrame:
    """Step 1: a row for each document, in DOCS. The answers are written, so that the first shuffle's files can go."""
    rows = only(docs)
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    segments = int(max(2, shuffle_partitions(docs.sparkSession), total / 6 / SEGMENT_TOKENS))
    sent = rows.mapInArrow(cut_blocks(segments), BLOCKS)
    answered = stored(sent.groupBy("part").applyInArrow(count_segment, ANSWERS), folder, "answers")
    freed(docs.sparkSession)
    return answered.groupBy("blk").applyInArrow(finish_block, DOCS)


def linked(n: int, m: int, common: int) -> bool:
    return 100 * common >= NUM * (n + m - common)


def can_link(n: int, x: int, m: int, y: int) -> bool:
    """Whether sets of sizes n and m, of which x and y hashes occur elsewhere at all, can share enough.

    A link needs 100 / NUM + 1 times the intersection to reach n + m, and only the x and y hashes can be shared.
    """
    return (100 + NUM) * min(x, y) >= NUM * (n + m) and 100 * min(n, m) >= NUM * max(n, m)


def common_hashes(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


LINKS = "a long, b long"
LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, b, n, x, m, y (sizes and shared hashes of both): the linked pairs."""
    last, held = None, np.empty(0, U)
    for batch in batches:
        a, b, n, x, m, y = (batch.column(i).to_pylist() for i in range(6))
        keep = []
        for i in range(len(a)):
            if not can_link(n[i], len(x[i]) // 6, m[i], len(y[i]) // 6):
                continue
            if b[i] != last:
                last, held = b[i], unpack48(y[i])
            if linked(n[i], m[i], common_hashes(unpack48(x[i]), held)):
                keep.append((a[i], b[i]))
        yield arrow_batch(keep, LINK_SCHEMA)
    release()


def verify_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the members (c, n, sorted_set) of a chunk of either component: the linked pairs across."""
    for batch in batches:
        for i in range(batch.num_rows):
            left, right = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            ys = [(r["c"], r["n"], unpack48(r["sorted_set"])) for r in right]
            keep = []
            for r in left:
                x, n = unpack48(r["sorted_set"]), r["n"]
                keep += [(r["c"], c) for c, m, y in ys if can_link(n, len(x), m, len(y)) and linked(n, m, common_hashes(x, y))]
            yield arrow_batch(keep, LINK_SCHEMA)
    release()


def star_links(classes: DataFrame) -> DataFrame:
    """Step 4: linked (a, b), where b is the centre of posting lists that hold a, as many as a and b have to share."""
    postings = classes.select("c", "matches", (F.col("m") / F.col("n")).alias("shared"), F.explode("prefix").alias("hash"))
    centres = postings.groupBy("hash").agg(F.max(F.struct("shared", "c", "matches")).alias("r"), F.count("*").alias("members"))
    centres = centres.where("members > 1").select("hash", F.col("r.c").alias("b"), F.col("r.matches").alias("l"))
    met = split_join(postings.select("hash", "c", "matches"), centres, ["hash"]).where("c <> b")
    common = met.groupBy("c", "b").agg(F.count("*").alias("common"), F.min(F.least("matches", "l")).alias("least")).where("common >= least")
    nearest = F.slice(F.sort_array(F.collect_list(F.struct("common", "b")), asc=False), 1, CENTRES)  # at most a prefix long
    pairs = common.groupBy(F.col("c").alias("a")).agg(nearest.alias("r")).select("a", F.explode("r.b").alias("b"))
    left = classes.select(F.col("c").alias("a"), "n", F.col("sorted_set").alias("x"))
    right = classes.select(F.col("c").alias("b"), F.col("n").alias("o"), F.col("sorted_set").alias("y"))
    rows = split_join(pairs.join(left, "a"), right, ["b"]).select("a", "b", "n", "x", "o", "y")
    return rows.mapInArrow(verify_pairs, LINKS)


def candidate_components(classes: DataFrame) -> DataFrame:
    """Step 5: pairs of components that share enough prefix hashes.

    A linked pair meets under each of its shared hashes, and there the bound of `can_link` must hold for the members
    with the most shared hashes and the smallest sets, less the rare hashes that all members of one component have and
    no member of the other; so a text that is too much its own meets nothing.
    """
    reach = (100 + NUM) * F.col("m") - NUM * F.col("n")  # the largest NUM * size of a partner
    postings = classes.select("comp", "matches", "n", "rare", reach.alias("reach"), F.explode("prefix").alias("hash"))
    postings = postings.groupBy("hash", "comp").agg(
        F.min("matches").alias("l"), F.max("reach").alias("reach"), (NUM * F.min("n")).alias("size"), F.bit_and("rare").alias("all"), F.bit_or("rare").alias("any")
    )
    lists = postings.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1").select("hash", F.ceil(F.col("k") / LIST).cast("int").alias("slices"))
    slice_ = F.pmod(F.xxhash64("comp"), F.col("slices")).cast("int")
    dealt = split_join(postings, lists, ["hash"]).withColumn("slice", slice_).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.withColumn("low", F.least("slice", "other")).withColumn("high", F.greatest("slice", "other"))
    keys = ["hash", "low", "high"]
    of = lambda c: dealt.select(*keys, *[F.col(x).alias(f"{x}_{c}") for x in ("comp", "slice", "l", "reach", "size", "all", "any")])
    enough = lambda a, b: f"reach_{a} - {100 + NUM} * bit_count(all_{a} & ~any_{b}) >= size_{b}"
    once = "(low = high or slice_p <> slice_q)"  # two of one slice meet in its own pair alone
    pairs = of("p").join(of("q"), keys).where(f"comp_p < comp_q and {once} and {enough('p', 'q')} and {enough('q', 'p')}")
    shared = pairs.groupBy(F.col("comp_p").alias("p"), F.col("comp_q").alias("q"))
    shared = shared.agg(F.count("*").alias("shared"), F.min("l_p").alias("l_p"), F.min("l_q").alias("l_q"))
    return shared.where(F.col("shared") >= F.least("l_p", "l_q")).select("p", "q")


def cross_links(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Step 6: linked (a, b) across the pairs of components, chunk by chunk; the smaller component travels."""
    sizes = classes.groupBy("comp").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    of = lambda c: sizes.select(F.col("comp").alias(c), F.col("chunks").alias(f"chunks_{c}"))
    pairs = split_join(split_join(pairs, of("p"), ["p"]), of("q"), ["q"])
    swap = F.col("chunks_p") > F.col("chunks_q")
    pick = lambda a, b: [F.when(swap, F.col(f"{x}{b}")).otherwise(F.col(f"{x}{a}")).alias(f"{x}{a}") for x in ("", "chunks_")]
    pairs = pairs.select(*pick("p", "q"), *pick("q", "p"))
    wanted = pairs.select(F.col("p").alias("comp")).union(pairs.select(F.col("q").alias("comp"))).distinct()
    members = split_join(split_join(classes, wanted, ["comp"]), sizes, ["comp"])
    members = members.withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")))
    members = members.groupBy("comp", "chunk").agg(F.collect_list(F.struct("c", "n", "sorted_set")).alias("rows"))
    left = members.select(F.col("comp").alias("p"), F.col("chunk").alias("i"), F.col("rows").alias("x"))
    right = members.select(F.col("comp").alias("q"), F.col("chunk").alias("j"), F.col("rows").alias("y"))
    number = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    pairs = pairs.withColumn("i", number("chunks_p")).withColumn("j", number("chunks_q")).select("p", "i", "q", "j")
    return split_join(split_join(pairs, left, ["p", "i"]), right, ["q", "j"]).select("x", "y").mapInArrow(verify_chunks, LINKS)


def near_duplicates(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach, the document's own included)."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "ngram-join")
    whole = stored(described(docs, folder), folder, "documents")
    deleted(spark, folder, "answers")
    freed(spark)
    classes = whole.where("sorted_set is not null").groupBy("sig").agg(F.first(F.struct("n", "m", "rare", "matches", "sorted_set", "prefix")).alias("r"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("c"), "sig", "r.*"), folder, "classes")
    rows = stored(whole.select("doc_id", "n", "sig"), folder, "sizes")
    deleted(spark, folder, "documents")
    freed(spark)
    first_links = stored(star_links(classes), folder, "star-links")
    freed(spark)
    stars = stored(components(first_links, folder, "stars").select(F.col("v").alias("c"), "label"), folder, "starred")
    grouped = classes.join(stars, "c", "left").withColumn("comp", F.coalesce("label", "c")).drop("label", "sig")
    pairs = stored(candidate_components(grouped), folder, "pairs")
    freed(spark)
    links = stored(cross_links(grouped, pairs), folder, "links")
    freed(spark)
    if links.isEmpty():
        found = stars
    else:
        edges = stars.where("c <> label").select(F.col("c").alias("a"), F.col("label").alias("b")).union(links)
        found = components(edges, folder, "all").select(F.col("v").alias("c"), "label")
    first = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    first = first.join(classes.select("sig", "c").join(found, "c"), "sig", "left").where("copies > 1 or label is not null")
    first = stored(first.select("sig", "first", "label"), folder, "first")
    least = first.where("label is not null").groupBy("label").agg(F.min("first").alias("least"))
    named = split_join(first, least, ["label"], "left").select("sig", F.coalesce("least", "first").alias("component_id"))
    named = stored(named, folder, "named")
    deleted(spark, folder, "classes", "links", "pairs", "first", "star-links")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(named, "sig", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS m, b.n AS n, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (m + n - c)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.other = b.x)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(other) FROM r WHERE r.doc_id = s.doc_id) AS component_id FROM s
"""
