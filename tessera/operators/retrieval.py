"""Exact top-k retrieval: a stated set of questions, in blocks, against all chunks.

Each task scores its rows against one block of questions with a matrix product and hands on its own best k for each
question, so what is shuffled grows with tasks * questions * k and not with rows * questions. Zero and negative scores
count, so every question gets min(k, n) rows. Blocks are cut by `BLOCK_QUESTIONS`; where there are several, each is a job
of its own whose candidates are written, so a question set of any size is never in memory as a whole. A task keeps a
running best k and never the candidates of all its rows. Hashed vectors are screened (`screening`), and only pairs that can reach a question's
best k so far are scored exactly. Where there are many questions, each distinct vector of a question is asked once, and of each distinct
vector of a chunk the k first chunks are looked at; the work is still the product of distinct questions and chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.config import DEFAULTS
from tessera.operators.embedding import VECTORS, dense, signed_buckets
from tessera.operators.screening import DIGITS, Sparse, finder, sparse
from tessera.tables import deleted, stored, work_dir

BLOCK_QUESTIONS = 2000
#: Rows scored at once by a task.
ROWS = 2048
#: Times as many rows at once, and questions in a block at most, where hashed questions are many; blocks in one job.
MANY, TOGETHER = 16, 8
#: A task cuts its candidates to the best when it holds so many times as many.
KEPT = 8


def blocks(rows: DataFrame, key: str, size: int) -> tuple[int, Iterator[list]]:
    """The number of blocks of about `size` rows, by a hash of the key, and the blocks; an empty table is one empty block."""
    shares = -(-rows.count() // size) or 1
    pick = lambda k: rows if shares == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(shares)) == k)
    return shares, (pick(k).collect() for k in range(shares))


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row (question) its best k columns; of equal scores the first columns."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above, equal = scores > kth, scores == kth
    return above | (equal & (equal.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))


def ranked(candidates: DataFrame, qid: str, key: str, k: int) -> DataFrame:
    order = W.partitionBy(qid).orderBy(F.desc("score"), key)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scored(rows: DataFrame, key: str, vectors, questions: list[tuple], qid: str, qkind: str, score, k: int, size: int) -> DataFrame:
    """Candidates (qid, key, score) of one block. vectors: batch -> matrix; score() gives a task's function of a matrix, with a row for each
    question's candidates: (questions, rows, scores)."""
    kind = rows.schema[key].dataType.simpleString()
    ids = [q[0] for q in questions]

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["q", "score", key], ascending=[True, False, True])
        return frame.groupby("q", sort=False).head(k)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """About `size` rows each but for the last, as batches of long texts are small."""
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            for at in range(0, len(batch), size):
                waiting.append(batch.iloc[at : at + size])
                if sum(map(len, waiting)) >= size:
                    yield pd.concat(waiting)
                    waiting = []
        if waiting:
            yield pd.concat(waiting)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        find = score()
        for part in parts(batches):
            if ids:
                part = part.sort_values(key)
                q, r, s = find(vectors(part))
                held.append(pd.DataFrame({"q": q, key: part[key].to_numpy()[r], "score": s}))
                size += len(q)
                if size > KEPT * k * len(ids):
                    held = [best(pd.concat(held))]
                    size = len(held[0])
        if held:
            frame = best(pd.concat(held))
            frame.insert(0, qid, [ids[i] for i in frame["q"]])
            yield frame[[qid, key, "score"]]

    return rows.mapInPandas(run, f"{qid} {qkind}, {key} {kind}, score double")


def top_k(rows: DataFrame, key: str, questions: DataFrame, qid: str, k: int, vectors, prepare, score_of, block: int, size: int) -> DataFrame:
    """block: questions in a block; size: rows scored at once."""
    qkind = questions.schema[qid].dataType.simpleString()
    shares, parts = blocks(questions, qid, block)
    folder = work_dir(rows.sparkSession, "top-k") if shares > 1 else ""
    rows = stored(rows, folder, "vectors") if shares > 1 and size == ROWS else rows  # else each block would make them anew
    found = []
    for at in range(0, shares, TOGETHER):
        blocks_at = islice(parts, TOGETHER)
        part = reduce(DataFrame.union, [scored(rows, key, vectors, [(r[qid],) for r in b], qid, qkind, score_of(prepare(b)), k, size) for b in blocks_at])
        found.append(stored(part, folder, f"block-{at}") if shares > 1 else part)
    best = ranked(reduce(DataFrame.union, found), qid, key, k).select(qid, "rank", key, "score")
    if shares > 1:
        best = stored(best, folder, "best")
        deleted(rows.sparkSession, folder, *["vectors"] * (size == ROWS), *[f"block-{at}" for at in range(0, shares, TOGETHER)])
    return best


def top_k_hashed(
    chunks: DataFrame, key: str, questions: DataFrame, qid: str, k: int = DEFAULTS.top_k, dim: int = DEFAULTS.embed_dim
) -> DataFrame:
    """qid, rank, key, score by hashed embeddings of the columns `text`; a text that is null has no words.

    Vectors are whole numbers, so products and lengths are exact and the score is one division of exact values.
    """
    placed = lambda df, name: df.select(name, F.coalesce(signed_buckets(F.col("text"), dim), F.array().cast("array<int>")).alias("places"))
    rows, asked = placed(chunks, key), placed(questions, qid)

    def matrix(places) -> np.ndarray:
        return dense([np.asarray(p, np.int64) for p in places], dim)

    def prepare(column: str, make):
        return lambda block: sparse((make([r[column] for r in block[at : at + ROWS]]) for at in range(0, len(block), ROWS)), dim)

    if asked.count() <= BLOCK_QUESTIONS:
        found = prepare("places", matrix)
        return top_k(rows, key, asked, qid, k, lambda batch: matrix(batch["places"]), found, lambda q: lambda: finder(q, k), BLOCK_QUESTIONS, ROWS)
    folder = work_dir(chunks.sparkSession, "distinct")
    asked = stored(packed(asked, qid, dim), folder, "asked")
    once = stored(asked.groupBy("vector_id").agg(F.first("vector").alias("vector")), folder, "questions")
    copies = F.row_number().over(W.partitionBy("vector_id").orderBy(key))
    rows = stored(packed(rows, key, dim).withColumn("copy", copies).where(F.col("copy") <= k).select(key, "vector"), folder, "rows")
    size = ROWS * MANY
    rows = rows.coalesce(-(-rows.count() // size) or 1)  # sums over few rows are slow: tasks are made by blocks of questions too
    block = min(BLOCK_QUESTIONS * MANY, max(BLOCK_QUESTIONS, -(-once.count() // TOGETHER)))
    found = top_k(
        rows, key, once, "vector_id", k, lambda batch: unpacked(batch["vector"].tolist(), dim), prepare("vector", lambda v: unpacked(v, dim)),
        lambda q: lambda: finder(q, k, True), block, size,
    )
    best = stored(asked.join(found, "vector_id").select(qid, "rank", key, "score"), folder, "best")
    deleted(chunks.sparkSession, folder, "asked", "questions", "rows")
    return best


def packed(rows: DataFrame, key: str, dim: int) -> DataFrame:
    """key, vector, vector_id: the bytes of the vector's whole numbers, two each or four where they need them, and their digest."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors: list[bytes] = []
            places = b.column("places")
            ends = places.value_lengths().to_numpy(zero_copy_only=False).cumsum()
            flat = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, b.num_rows, VECTORS):
                own = np.r_[ends[at - 1] if at else 0, ends[at : at + VECTORS]]
                m = dense([flat[x:y] for x, y in pairwise(own.tolist())], dim)
                short = np.abs(m).max(axis=1) < 1 << 15
                vectors += [v.astype("<i2" if s else "<i4").tobytes() for v, s in zip(m, short.tolist(), strict=True)]
            ids = [hashlib.sha256(v).digest() for v in vectors]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(vectors, pa.binary()), pa.array(ids, pa.binary())], [key, "vector", "vector_id"])

    return rows.mapInArrow(run, f"`{key}` {kind}, vector binary, vector_id binary")


def unpacked(vectors: list[bytes], dim: int) -> np.ndarray:
    if all(len(v) == 2 * dim for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i2").reshape(-1, dim)
    return np.stack([np.frombuffer(v, "<i2" if len(v) == 2 * dim else "<i4").astype(np.int32) for v in vectors])


def top_k_dense(rows: DataFrame, key: str, questions: DataFrame, qid: str, k: int = DEFAULTS.top_k, vector: str = "embedding") -> DataFrame:
    """The same over dense vectors of one length, by cosine. Sums run in the order of the dimensions."""

    def stack(values) -> np.ndarray:
        return np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.empty((0, 0))

    def total(m: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(m)))
        for j in range(m.shape[1] if q.size else 0):
            out += q[:, j : j + 1] * m[:, j][None, :]
        return out

    def score_of(q: np.ndarray):
        q2 = np.array([total(x[None, :], x[None, :])[0, 0] for x in q])

        def score(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            m2 = np.zeros(len(m))
            for j in range(m.shape[1]):
                m2 += m[:, j] * m[:, j]
            length = np.sqrt(q2)[:, None] * np.sqrt(m2)[None, :]
            s = np.round(total(m, q) / np.where(length == 0, 1.0, length), DIGITS)
            return (*(found := np.nonzero(best_of(s, k))), s[found])

        return lambda: score

    asked = questions.select(F.col(qid), F.col(vector).alias("vector"))
    return top_k(
        rows.select(key, F.col(vector).alias("vector")), key, asked, qid, k, lambda b: stack(b["vector"].tolist()),
        lambda block: stack([r["vector"] for r in block]), score_of, BLOCK_QUESTIONS, ROWS,
    )


def similarity_gate(questions: DataFrame, retrieved: DataFrame, qid: str, least: float = DEFAULTS.min_similarity) -> DataFrame:
    """qid, best, passed: whether the best chunk reaches the cutoff. Questions without any chunk fail."""
    best = retrieved.where("rank = 1").select(qid, F.col("score").alias("best"))
    return questions.select(qid).join(best, qid, "left").withColumn("passed", F.coalesce(F.col("best") >= least, F.lit(False)))


def context(retrieved: DataFrame, qid: str, headed: bool = True) -> DataFrame:
    """qid, context: the numbered sources of a question. retrieved: qid, rank, page, source, text; k rows each."""
    head = F.concat(F.lit("["), "rank", F.lit("] (page "), "page", F.lit(", "), "source", F.lit(")\n")) if headed else F.concat(F.lit("["), "rank", F.lit("]\n"))
    rows = retrieved.select(qid, F.struct("rank", F.concat(head, "text").alias("part")).alias("x"))
    parts = rows.groupBy(qid).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return parts.select(qid, F.array_join(F.transform("xs", lambda x: x["part"]), "\n\n").alias("context"))
