"""Language ID by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of its labelled text. A document is parsed into the
longest phrases that occur in that text: the automaton is followed letter by letter, and where no transition goes
on, a phrase ends and the next begins. The language whose text needs the fewest phrases, normalised by the length of
that text (phrases * log2(training letters) / letters), wins. Texts are parsed whole, in blocks of `BLOCK` letters
(a phrase ends at a block's end), so that numpy follows thousands of blocks at once. Every letter of the training texts
has its own code. Transitions are a table of states and the language's own letters, or, where letters are many (such as
Han), a sorted list.

Before both training and parsing, letters are lower-cased and each run of other characters is one space.

Defined results: a text that is null, empty or without a letter is `und` with score 0; ties go to the language whose
name sorts first; characters never seen in training make a phrase of their own in every language; rows without a
doc_id are predicted like others; with no labelled text everything is `und`; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tessera.llm.common import gathered, held_out, only, release, stored, take_turn, work_dir

#: Training bound: characters for each language, from at most so many documents; the last one is cut to it.
TRAIN_LETTERS = 40_000
TRAIN_DOCS = 200
#: Languages that a worker holds at once; more are parsed in several passes over the table.
PASS_LANGUAGES = 24
#: Ids of training documents that are literals of a filter at most; more are joined.
LITERALS = 10_000
BLOCK = 256
#: Code points worked on at once.
CHUNK = 750_000
#: Bytes that the tables of all languages may take; a language whose table is above its share has a sorted list.
TABLE_BYTES = 1 << 28
_models: dict[tuple, "CrossParser"] = {}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the states; 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


class Letters:
    """Code point -> code: 0 for what is no letter, 1.. for known letters, then one for all others."""

    def __init__(self, texts: list[str]):
        known = sorted({c for t in texts for c in t.lower() if c.isalpha()})
        self.unknown = len(known) + 1
        number = {c: n + 1 for n, c in enumerate(known)}
        self.table = np.zeros(0x110000, np.min_scalar_type(self.unknown))
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                self.table[i] = number.get(c.lower()[0], self.unknown)

    def codes(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes with runs of spaces as one, none at a text's start, and where each text starts in them."""
        codes = self.table[points]
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        keep[starts[:-1][starts[:-1] < len(codes)]] = True
        lead = starts[:-1][starts[:-1] < starts[1:]]
        keep[lead[codes[lead] == 0]] = False
        before = np.concatenate([[0], np.cumsum(keep)])
        return codes[keep], before[starts]


class Parser:
    """One language's automaton. Codes become its own: 0 for what its text does not hold, 1.. for the others."""

    def __init__(self, codes: np.ndarray, size: int, share: int):
        known, text = np.unique(codes, return_inverse=True)
        self.own = np.zeros(size, np.int64)
        self.own[known] = np.arange(1, len(known) + 1)
        self.bits = np.log2(max(2, len(codes)))
        moves = suffix_automaton((text + 1).tolist())
        self.width = width = len(known) + 1
        self.dense = 4 * len(moves) * width <= share
        self.root = np.zeros(width, np.int64)
        for c, to in moves[0].items():
            self.root[c] = to
        if self.dense:
            table = np.empty((len(moves), width), np.uint32)
            table[:] = self.root * width | 1 << 31  # a phrase begins, unless a transition goes on
            for state, row in enumerate(moves):
                if state:
                    for c, to in row.items():
                        table[state, c] = to * width
            self.table = table.ravel()
        else:
            found = sorted((state * width + c, to) for state, row in enumerate(moves) if state for c, to in row.items())
            self.keys = np.array([k for k, _ in found] + [np.iinfo(np.int64).max], np.int64)
            self.to = np.array([to for _, to in found], np.int64)

    def count(self, steps: list[np.ndarray]) -> np.ndarray:
        """Phrases of each block; steps are the codes at the first place of all blocks, at the second, and so on."""
        count = np.zeros(len(steps[0]) if steps else 0, np.uint32)
        state = np.zeros(len(count), np.int64)
        for codes in steps:
            m = len(codes)
            c = self.own.take(codes)
            if self.dense:
                got = self.table.take(state[:m] + c)
                count[:m] += got >> np.uint32(31)
                state[:m] = got & np.uint32(0x7FFFFFFF)
                continue
            now, begun = self.root.take(c), np.ones(m, np.uint32)
            inner = np.flatnonzero((state[:m] != 0) & (c != 0))
            key = state[inner] * self.width + c[inner]
            place = np.searchsorted(self.keys, key)
            hit = self.keys[place] == key
            now[inner[hit]] = self.to[place[hit]]
            begun[inner[hit]] = 0
            count[:m] += begun
            state[:m] = now
        return count


class CrossParser:
    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = [lang for lang, _ in samples]
        self.letters = Letters([t for _, t in samples])
        self.parsers = []
        for _, text in samples:
            codes, _ = self.letters.codes(points_of([text])[0], np.array([0, len(text)]))
            self.parsers.append(Parser(codes, self.letters.unknown + 1, TABLE_BYTES // len(samples)))
        self.bits = [p.bits for p in self.parsers]

    def phrases(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        sizes = np.diff(starts)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
        begin = starts[:-1][owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        end = np.minimum(begin + BLOCK, starts[1:][owner])
        order = np.argsort(begin - end, kind="stable")  # longest first: short blocks leave early
        begin, end, owner = begin[order], end[order], owner[order]
        length = end - begin
        alive = np.searchsorted(-length, -np.arange(1, BLOCK + 1), side="right")
        steps = [codes[begin[:m] + t] for t, m in enumerate(alive.tolist()) if m]
        return np.stack([np.bincount(owner, p.count(steps), len(sizes)) for p in self.parsers], axis=1)

    def nearest(self, texts: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Each text's language (None without a letter), its rate and the second least (infinite without another)."""
        points, starts = points_of(texts)
        codes, starts = self.letters.codes(points, starts)
        has = np.diff(np.concatenate([[0], np.cumsum(codes != 0)])[starts]) > 0
        size = np.maximum(1, np.diff(starts))
        rate = self.phrases(codes, starts) * np.array(self.bits) / size[:, None]
        best = rate.argmin(axis=1)
        least = rate[np.arange(len(texts)), best]
        rate[np.arange(len(texts)), best] = np.inf
        return [self.languages[b] if h else None for b, h in zip(best, has, strict=True)], least, rate.min(axis=1)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        found, least, second = self.nearest(texts)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, second / np.maximum(least + second, 1e-9))
        return ["und" if x is None else x for x in found], np.where([x is not None for x in found], score, 0.0).tolist()


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), starts


def training_sample(labelled: DataFrame) -> list[tuple[str, str]]:
    """(language, text) by language, from the columns doc_id, text, lang; bounded by the constants above.

    The first look reads ids, labels and lengths alone and keeps TRAIN_DOCS rows a language, in an order that a hash
    of the ids gives; the second reads the beginnings of the chosen texts. Of rows that repeat an id in a language the
    first text in order counts, so neither their number nor a text's length reaches the driver.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "length")
    sizes = rows.select("doc_id", "lang", F.least(F.length("text"), F.lit(TRAIN_LETTERS)).alias("length"))
    few = sizes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TRAIN_DOCS)
    chosen: dict[str, set[int]] = {}
    used: dict[str, int] = {}
    for r in sorted(few.collect(), key=lambda r: (r.lang, r.place)):
        if used.get(r.lang, 0) < TRAIN_LETTERS and r.doc_id not in chosen.get(r.lang, ()):
            used[r.lang] = used.get(r.lang, 0) + r.length
            chosen.setdefault(r.lang, set()).add(r.doc_id)
    ids = sorted(set().union(*chosen.values()))
    if not ids:
        return []
    picked = rows.where(F.col("doc_id").isin(ids))
    if len(ids) > LITERALS:
        wanted = labelled.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
        picked = rows.join(F.broadcast(wanted), "doc_id", "left_semi")
    picked = picked.select("doc_id", "lang", F.substring("text", 1, TRAIN_LETTERS).alias("text")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    texts: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.lang, r.doc_id)):
        if r.doc_id in chosen.get(r.lang, ()):
            texts.setdefault(r.lang, []).append(r.text)
    return [(lang, " ".join(t)[:TRAIN_LETTERS]) for lang, t in sorted(texts.items())]


def parsed(rows: DataFrame, samples: list[tuple[str, str]], names: list[str], what: str) -> DataFrame:
    """All columns of rows but the last, the text; then what CrossParser.predict or CrossParser.nearest gives."""
    kept = rows.schema.fields[:-1]
    kinds = [T.StringType(), *[T.DoubleType()] * (len(names) - 1)]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), *map(T.StructField, names, kinds)])
    key = tuple(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("language ID", _models.clear)
        if key not in _models:
            _models.clear()
            _models[key] = CrossParser(samples)
        model = _models[key]
        for batch in gathered(batches, CHUNK):
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            out: list[list] = [[] for _ in names]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end])
                    end += 1
                for held, more in zip(out, getattr(model, what)(texts[at:end]), strict=True):
                    held += list(more)
                at = end
            arrays = [batch.column(i) for i in range(len(kept))]
            found = [pa.array(x, pa.float64() if i else pa.string()) for i, x in enumerate(out)]
            yield pa.RecordBatch.from_arrays([*arrays, *found], [*(f.name for f in kept), *names])
        release()

    return rows.mapInArrow(run, schema)


def predict_language(docs: DataFrame, samples: list[tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `keep`, then lang_pred and score, for each row of docs (which needs a column text)."""
    own = [f"kept_{i}" for i in range(len(keep))]
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, own, strict=True)]
    rows = docs.select(*columns, F.col("text").cast("string").alias("parsed_text"))
    if len(samples) <= PASS_LANGUAGES:
        return parsed(rows, samples, ["lang_pred", "score"], "predict").toDF(*keep, "lang_pred", "score")
    folder = work_dir(docs.sparkSession, "language-id")
    rows = stored(rows.select("*", F.monotonically_increasing_id().alias("row")), folder, "rows")
    groups = [samples[i : i + PASS_LANGUAGES] for i in range(0, len(samples), PASS_LANGUAGES)]
    passes = [stored(parsed(rows.select("row", "parsed_text"), g, ["lang", "least", "second"], "nearest"), folder, f"pass-{k}") for k, g in enumerate(groups)]
    near = F.array_sort(F.flatten(F.collect_list(F.array("least", "second"))))
    both = reduce(DataFrame.union, passes).groupBy("row").agg(F.min(F.struct("least", "lang"))["lang"].alias("lang_pred"), near.alias("near"))
    score = F.col("near")[1] / F.greatest(F.col("near")[0] + F.col("near")[1], F.lit(1e-9))
    score = F.when(F.col("lang_pred").isNull(), 0.0).otherwise(score).alias("score")
    return rows.join(both, "row").select(*own, F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score).toDF(*keep, "lang_pred", "score")


def language_id(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows of the held-out fold are never learned from."""
    rows = only(docs).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    samples = training_sample(labelled.where(~held_out(F.col("doc_id"), folds, fold)))
    return predict_language(rows, samples, ("doc_id", "held_out"))
