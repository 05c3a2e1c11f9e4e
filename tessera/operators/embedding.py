"""Embeddings: signed hashing in SQL, and a plug-in for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULTS

#: Words that carry no weight.
STOP_WORDS = (
    "a an and are as at be by for from has have how in is it its of on or that the "
    "this to was were what when where which who why will with does do did can"
).split()

#: Rows whose vectors a task holds at once.
VECTORS = 256

#: texts -> one vector (all of the same length) each
Encoder = Callable[[list[str]], np.ndarray]


def terms(text: Column) -> Column:
    """Lower-cased words without stop words, a plural s dropped."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    found = F.filter(found, lambda w: ~w.isin(STOP_WORDS))
    shorter = lambda w: F.substring(w, F.lit(1), F.length(w) - 1)
    return F.transform(found, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), shorter(w)).otherwise(w))


def signed_buckets(text: Column, dim: int = DEFAULTS.embed_dim) -> Column:
    """For each term its bucket plus one, negative where the hash's sign bit is 0. The vector without an aggregate."""

    def place(word: Column) -> Column:
        h = F.crc32(word.cast("binary"))
        sign = F.when(F.shiftright(h, 16).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)
        return (sign * (h % dim + 1)).cast("int")

    return F.transform(terms(text), place)


def hash_embed(rows: DataFrame, key: str, text: str = "text", dim: int = DEFAULTS.embed_dim) -> DataFrame:
    """key, bucket, value (a whole number), norm2 (the squared length): the sparse vectors, zero buckets left out.

    A row's vector is made in its own task. Only rows whose keys are repeated are added up in a shuffle; keys that are null have no vector.
    """
    rows = rows.select(key, F.col(text).alias("text")).where(F.col(key).isNotNull())
    repeated = rows.groupBy(key).count().where("count > 1").select(key)
    if repeated.isEmpty():
        return sparse(rows, key, dim)
    sums = sparse(rows.join(repeated, key, "left_semi"), key, dim).groupBy(key, "bucket").agg(F.sum("value").alias("value")).where("value <> 0")
    norms = sums.groupBy(key).agg(F.sum(F.col("value") * F.col("value")).alias("norm2"))
    return sparse(rows.join(repeated, key, "left_anti"), key, dim).union(sums.join(norms, key).select(key, "bucket", "value", "norm2"))


def sparse(rows: DataFrame, key: str, dim: int) -> DataFrame:
    """key, bucket, value, norm2 of each row's own vector."""
    placed = rows.select(key, signed_buckets(F.col("text"), dim).alias("places"))
    kind = placed.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = b.column("places")
            owner = np.repeat(np.arange(b.num_rows), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, b.num_rows, VECTORS):
                end = min(at + VECTORS, b.num_rows)
                own = slice(*np.searchsorted(owner, (at, end)))
                v = np.bincount((owner[own] - at) * dim + np.abs(flat[own]) - 1, np.sign(flat[own]), (end - at) * dim).astype(np.int64).reshape(-1, dim)
                row, bucket = np.nonzero(v)
                columns = [b.column(key).take(pa.array(row + at)), pa.array(bucket, pa.int32()), *(pa.array(x) for x in (v[row, bucket], (v * v).sum(axis=1)[row]))]
                yield pa.RecordBatch.from_arrays(columns, [key, "bucket", "value", "norm2"])

    return placed.mapInArrow(run, f"`{key}` {kind}, bucket int, value long, norm2 long")


def dense(places: list[np.ndarray], dim: int) -> np.ndarray:
    """Whole-number vectors (rows) of signed buckets."""
    owner = np.repeat(np.arange(len(places)), [len(p) for p in places])
    flat = np.concatenate(places).astype(np.int64) if len(places) else np.empty(0, np.int64)
    return np.bincount(owner * dim + np.abs(flat) - 1, np.sign(flat), len(places) * dim).reshape(len(places), dim)


def model_embeddings(rows: DataFrame, key: str, load: Callable[[], Encoder], text: str = "text") -> DataFrame:
    """key, embedding by a model that `load` opens once a worker; vectors are brought to length 1."""
    kind = rows.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            vectors = np.asarray(model(batch[text].fillna("").tolist()), np.float64).reshape(len(batch), -1)
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.DataFrame({key: batch[key], "embedding": list(vectors / np.where(length == 0, 1.0, length))})

    return rows.select(key, text).mapInPandas(encode, f"{key} {kind}, embedding array<double>")


def sentence_transformer(name: str = DEFAULTS.embed_model) -> Callable[[], Encoder]:
    """A loader for model_embeddings; needs sentence-transformers on the executors."""

    def load() -> Encoder:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name)
        return lambda texts: model.encode(texts, normalize_embeddings=True)

    return load
