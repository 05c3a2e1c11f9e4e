"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give scores and offsets.

Training. Labels are given per document, so labelled tokens come first: word features (the word, its first 3 to 7 and
last 3 to 5 letters) are counted in toxic and clean documents, and a greedy cover picks those that occur nearly
in toxic documents alone, and too often for chance, until every toxic document that can be is covered. Words with a picked feature in toxic
documents are tagged toxic, all others clean. On these the CRF (two tags, the same features, tag transitions) is
fitted by gradient steps on the exact log-likelihood. A logistic curve over the documents' largest marginal and
expected number of toxic words turns marginals into a score.

The classifier is fitted on a bounded sample: `TRAIN_DOCS` toxic and three times as many clean labelled documents of
up to `TRAIN_CHARS` characters, in the order of a hash of their ids. Scoring reads every whole text.

Defined results: null, empty or wordless texts have the score that the curve gives to no evidence; documents with
contradictory or repeated labels count as toxic when one says so; with one kind of label only, the score is that
kind's share; other columns are ignored. Labels of held-out documents are never read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import gathered, held_out, release, take_turn

TRAIN_DOCS = 1500
TRAIN_CHARS = 20_000
FEATURE_BITS = 20
PICKED_FEATURES = 400
LEAST_PRECISION = 0.98
#: Chance, over all features, that one is picked which says nothing about toxicity.
LEAST_SURE = 0.05
#: Features beside the cover must be in so large a part of the toxic documents.
LEAST_SHARE = 0.02
STEPS = 40
CACHED_WORDS = 200_000
#: Bytes of text tagged at once, all documents in step.
CHUNK = 12_000_000
WORDS = re.compile(r"[^\W_]+")
N_FEATURES = 1 << FEATURE_BITS
_caches: dict[str, dict[str, float]] = {}


def features(word: str) -> list[int]:
    """Hashed features of a word; always 10, where short words repeat the whole word and one stands for any word."""
    raw = [word, "", *(f"{word[:k]}<" if len(word) >= k else word for k in range(3, 8))]
    raw += [f">{word[-k:]}" if len(word) >= k else word for k in range(3, 6)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (N_FEATURES - 1) for x in raw]


def odds(e: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Odds of the toxic tag at each word, by forward and backward ratios over all documents in step.

    e: toxic minus clean emission of each word, documents one after the other; t: log potentials of tag pairs.
    """
    w = np.exp(np.clip(t, -30, 30))
    x = np.exp(np.clip(e, -30, 30))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    order = np.argsort(-sizes, kind="stable")
    first, size = starts[order], sizes[order]
    most = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, most + 1), side="right")
    ahead, back = np.empty_like(x), np.ones_like(x)
    r = np.ones(len(size))
    for k in range(most):
        m = alive[k]
        at = first[:m] + k
        p = r[:m]
        r[:m] = x[at] if k == 0 else x[at] * (w[0, 1] + p * w[1, 1]) / (w[0, 0] + p * w[1, 0])
        ahead[at] = r[:m]
    b = np.ones(len(size))
    for k in range(1, most):  # k-th word from the end
        m = alive[k]
        at = first[:m] + size[:m] - 1 - k
        g = x[at + 1] * b[:m]
        b[:m] = (w[1, 0] + w[1, 1] * g) / (w[0, 0] + w[0, 1] * g)
        back[at] = b[:m]
    return ahead * back


def pair_marginals(e: np.ndarray, sizes: np.ndarray, t: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Expected number of each tag pair, from word marginals: a pair's odds given the tag before it."""
    w = np.exp(np.clip(t, -30, 30))
    x = np.exp(np.clip(e, -30, 30))
    p = o / (1 + o)
    has = np.ones(len(e), bool)
    has[np.concatenate([[0], np.cumsum(sizes)])[:-1][sizes > 0]] = False
    now = np.flatnonzero(has)
    before = now - 1
    back = o[now] / np.maximum(1e-300, forward_only(e, sizes, t)[now])
    g = x[now] * back
    to1_0 = w[0, 1] * g / (w[0, 0] + w[0, 1] * g)
    to1_1 = w[1, 1] * g / (w[1, 0] + w[1, 1] * g)
    q = p[before]
    return np.array([[((1 - q) * (1 - to1_0)).sum(), ((1 - q) * to1_0).sum()], [(q * (1 - to1_1)).sum(), (q * to1_1).sum()]])


def forward_only(e: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> np.ndarray:
    w = np.exp(np.clip(t, -30, 30))
    x = np.exp(np.clip(e, -30, 30))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    order = np.argsort(-sizes, kind="stable")
    first, size = starts[order], sizes[order]
    most = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, most + 1), side="right")
    ahead, r = np.empty_like(x), np.ones(len(size))
    for k in range(most):
        m = alive[k]
        at = first[:m] + k
        p = r[:m]
        r[:m] = x[at] if k == 0 else x[at] * (w[0, 1] + p * w[1, 1]) / (w[0, 0] + p * w[1, 0])
        ahead[at] = r[:m]
    return ahead


def pick_features(rows: list[np.ndarray], toxic: np.ndarray) -> set[int]:
    """Greedy cover of the toxic documents by features that clean documents nearly lack. rows: features by document."""
    a, b = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for row, y in zip(rows, toxic, strict=True):
        (a if y else b)[row] += 1
    n_toxic, n_clean = toxic.sum(), (~toxic).sum()
    share = (a / n_toxic) / np.maximum(1e-12, a / n_toxic + b / n_clean)
    rate = n_toxic / (n_toxic + n_clean)
    by_chance = binomial(a, b) + a * np.log(rate) + b * np.log(1 - rate)
    good = (share >= LEAST_PRECISION) & (by_chance < -np.log(max(1, np.count_nonzero(a + b)) / LEAST_SURE))
    where: dict[int, list[int]] = {}
    for i in np.flatnonzero(toxic).tolist():
        for f in rows[i][good[rows[i]]].tolist():
            where.setdefault(f, []).append(i)
    gain = {f: len(d) for f, d in where.items()}
    covered: set[int] = set()
    picked: set[int] = set()
    ranked = sorted(gain, key=lambda f: (-gain[f], f))
    while ranked and len(picked) < PICKED_FEATURES:
        best, most = None, 0.0
        for f in ranked:
            if gain[f] * share[f] <= most:
                break  # gains only fall, and the ranking is by old gains
            now = sum(i not in covered for i in where[f]) * share[f]
            if now > most:
                best, most = f, now
        if best is None or most < 1.5:
            break
        picked.add(best)
        covered.update(where[best])
        for f in ranked:
            if gain[f] > 1 and f not in picked:
                gain[f] = min(gain[f], sum(i not in covered for i in where[f])) if len(where[f]) < 50 else gain[f]
        ranked = sorted((f for f in ranked if f not in picked and gain[f] > 1), key=lambda f: (-gain[f], f))
    # features as frequent that no clean document has tag too: the picked ones stand for them
    return picked | {f for f, d in where.items() if b[f] == 0 and len(d) >= LEAST_SHARE * n_toxic}


def binomial(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithms of the binomial coefficients (a + b over a)."""
    sums = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int((a + b).max()) + 2)))])
    n, k = (a + b).astype(int), a.astype(int)
    return sums[n] - sums[k] - sums[n - k]


class Tagger:
    """Weights of features (toxic minus clean), tag-pair potentials and the document curve."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, curve: tuple[float, float, float]):
        self.weights, self.pairs, self.curve = weights.astype(np.float32), pairs, curve
        self.name = hashlib.sha256(self.weights.tobytes() + pairs.tobytes() + repr(curve).encode()).hexdigest()

    def emissions(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        cache = _caches.setdefault(self.name, {})
        if len(cache) > CACHED_WORDS:
            cache.clear()
        weights, out = self.weights, []
        for words in docs:
            try:
                out += [cache[w] for w in words]
                continue
            except KeyError:
                fresh = [w for w in set(words) if w not in cache]
            index = np.array([features(w) for w in fresh])
            cache.update(zip(fresh, weights[index].sum(axis=1).tolist(), strict=True))
            out += [cache[w] for w in words]
        return np.array(out, np.float64), np.array([len(d) for d in docs], np.int64)

    def evidence(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(largest log odds, expected toxic words) of each document, and the odds of each word."""
        e, sizes = self.emissions(docs)
        o = odds(e, sizes, self.pairs)
        return *document_evidence(o, sizes), o

    def scores(self, top: np.ndarray, count: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a * top + b * count + c, -30, 30)))


def document_evidence(o: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top, count = np.full(len(sizes), -10.0), np.zeros(len(sizes))
    has = sizes > 0
    if has.any():
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1][has]
        p = o / (1 + o)
        top[has] = np.clip(np.log(np.maximum(1e-300, np.maximum.reduceat(o, starts))), -10, 10)
        count[has] = np.log1p(np.add.reduceat(np.where(p > 0.05, p, 0.0), starts))
    return top, count


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a lightly ridged logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


def fit(texts: list[str], labels: list[int]) -> Tagger:
    toxic = np.array(labels, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        share = float(toxic.mean()) if len(toxic) else 0.0
        at = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Tagger(np.zeros(N_FEATURES), np.zeros((2, 2)), (0.0, 0.0, at))
    number: dict[str, int] = {}
    ids = []
    for t in texts:
        ids.append(np.array([number.setdefault(w, len(number)) for w in WORDS.findall(t.lower())], np.int32))
    words = len(number)
    table = np.array([features(w) for w in number] or [[0] * 10], np.int32)
    del number
    picked = pick_features([np.unique(table[np.unique(i)]) if len(i) else np.empty(0, np.int32) for i in ids], toxic)
    marked = np.isin(table, np.fromiter(picked, np.int32, len(picked))).any(axis=1)
    clean = np.flatnonzero(~toxic)[: max(1, 2 * int(toxic.sum()))]
    used = np.concatenate([np.flatnonzero(toxic), clean])
    flat = np.concatenate([ids[i] for i in used])
    sizes = np.array([len(ids[i]) for i in used])
    tags = marked[flat] & np.repeat(toxic[used], sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    inside = np.ones(len(flat), bool)
    inside[starts[sizes > 0]] = False
    now = np.flatnonzero(inside)
    seen = np.array([[(~tags[now - 1] & ~tags[now]).sum(), (~tags[now - 1] & tags[now]).sum()], [(tags[now - 1] & ~tags[now]).sum(), (tags[now - 1] & tags[now]).sum()]], float)
    weights, pairs = np.zeros(N_FEATURES), np.zeros((2, 2))
    square_w, square_p = np.full(N_FEATURES, 1e-6), np.full((2, 2), 1e-6)
    gold = np.bincount(flat, tags, words)
    for _ in range(STEPS):  # Adagrad on the exact gradient
        emission = weights[table].sum(axis=1)
        e = emission[flat]
        o = odds(e, sizes, pairs)
        off = gold - np.bincount(flat, o / (1 + o), words)
        grad = np.bincount(table.ravel(), np.repeat(off, table.shape[1]), N_FEATURES) - 0.1 * weights
        grad_p = seen - pair_marginals(e, sizes, pairs, o) - 0.1 * pairs
        square_w += grad**2
        square_p += grad_p**2
        weights += 0.5 * grad / np.sqrt(square_w)
        pairs += 0.5 * grad_p / np.sqrt(square_p)
    emission = weights.astype(np.float32)[table].sum(axis=1).astype(np.float64)
    evidence = []
    for at in range(0, len(ids), 500):  # a part of the documents at once
        own = ids[at : at + 500]
        lengths = np.array([len(i) for i in own])
        evidence.append(np.column_stack(document_evidence(odds(emission[np.concatenate(own)], lengths, pairs), lengths)))
    a, b, c = logistic(np.concatenate(evidence), toxic.astype(float)).tolist()
    return Tagger(weights, pairs, (a, b, c))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, fold: int) -> tuple[list[str], list[int]]:
    """The bounded sample: ids from the labels alone, then a text of each (the first in order, where rows share an id)."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen: dict[int, int] = {}
    for toxic, most in ((1, TRAIN_DOCS), (0, 3 * TRAIN_DOCS)):
        rows = known.where((F.col("toxic") > 0) == F.lit(bool(toxic))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen |= {r.doc_id: toxic for r in rows.select("doc_id").collect()}
    if not chosen:
        return [], []
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in chosen], "doc_id long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = sorted(rows.collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    return [r.text for r in found], [chosen[r.doc_id] for r in found]


SCORES = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scoring(tagger: Tagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("toxicity", _caches.clear)
        for batch in gathered(batches, CHUNK):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            scores, spans, at = [], [], 0
            while at < len(texts):
                docs, size, begin = [], 0, at
                while at < len(texts) and (not docs or size < CHUNK):
                    docs.append(WORDS.findall(texts[at].lower()))
                    size += len(texts[at])
                    at += 1
                top, count, o = tagger.evidence(docs)
                own = tagger.scores(top, count)
                scores += own.tolist()
                ends = np.cumsum([len(d) for d in docs])
                for k, d in enumerate(docs):
                    hot = np.flatnonzero(o[ends[k] - len(d) : ends[k]] >= 1) if top[k] >= 0 else ()
                    spans.append(word_spans(texts[begin + k], set(hot.tolist())) if len(hot) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, SPANS)],
                names=["doc_id", "held_out", "score", "predicted", "spans"],
            )
        release()

    return run


def word_spans(text: str, hot: set[int]) -> list[dict[str, int]]:
    """Character offsets of the words whose numbers are in hot; words of the lower-cased text, where lengths agree."""
    low = text.lower()
    low = low if len(low) == len(text) else text
    return [{"start": m.start(), "end": m.end()} for k, m in enumerate(WORDS.finditer(low)) if k in hot]


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans (character offsets) of every document."""
    tagger = fit(*training_rows(docs, labels, folds, fold))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    return rows.mapInArrow(scoring(tagger), SCORES)
