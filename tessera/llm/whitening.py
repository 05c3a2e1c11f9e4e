"""Embedding whitening with an exact scatter matrix, by residue numbers.

Entries become whole numbers x = floor(1024 c) + 100000. The scatter of all x-vectors, with a leading one for counts and
sums, is needed exactly, but a double product of that many rows would round. So every task reduces its rows modulo a few
primes below 2^20 and multiplies the residues as doubles, `ROWS` rows at once, which is exact below 2^53; Spark adds up
the residues of all tasks. As many primes are taken as the measured count and largest entry ask for, so Chinese
remaindering gives the exact sums; they are centred as whole numbers, n G - S S', and only then become doubles for one
symmetric eigen decomposition. What reaches the driver is bounded by the square of the vectors' length.

The table is read four times and nothing is shuffled but sums: count and bounds, scatter, moments of the whitened rows,
result. `identity_error` is measured on the whitened rows themselves.

Defined results: rows whose vector is null, empty, holds a null or non-finite entry, or one whose x has no place in 62
bits, go, and so do vectors of another length than the most frequent (the longer one, on ties). All other rows count, repeated
ones and those with null id too. Components whose eigenvalue is zero up to rounding have a null `whitened` and
do not count for `identity_error`; without any variance `explained` and `identity_error` are null. Vectors shorter than
the number of components have as many as their length. A `deviation` that no long holds is null; `deviation_exact` has its
digits in any case. An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows multiplied at once, and the bound of the primes: ROWS * PRIMES_BELOW^2 <= 2^53.
ROWS = 4096
PRIMES_BELOW = 1 << 20
#: Bits of an entry's x at most.
ENTRY_BITS = 62
#: Bits of a limb of a squared deviation: sums of products of two limbs of 2^20 entries fit into 63 bits.
LIMB = 21
#: An eigenvalue below so many roundings of the largest, for each dimension, is zero.
ZERO = 4 * np.finfo(np.float64).eps
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


def whole(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a place, their x)."""
    with np.errstate(all="ignore"):
        scaled = np.floor(values * SCALE)
        fits = (np.abs(scaled) < 2.0**ENTRY_BITS).all(axis=1)
    return fits, scaled[fits].astype(np.int64) + SHIFT


def of_length(batch: pa.RecordBatch, length: int) -> tuple[pa.Array, np.ndarray]:
    """(ids, x) of the rows of a batch (id, vector) that remain."""
    ids, vectors = batch.column(0), batch.column(1)
    keep = pc.fill_null(pc.equal(pc.list_value_length(vectors), length), False)
    values = vectors.filter(keep).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    fits, x = whole(values)
    return ids.filter(keep).filter(pa.array(fits)), x


def lengths_of(rows: DataFrame) -> DataFrame:
    """length, n, largest: the rows that remain of each length of vector, and their largest absolute x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, int]] = {}
        for batch in batches:
            for length in pc.unique(pc.list_value_length(batch.column(1))).to_pylist():
                if length:
                    _, x = of_length(batch, length)
                    n, largest = found.get(length, (0, 0))
                    found[length] = n + len(x), max(largest, int(np.abs(x).max()) if len(x) else 0)
        yield pa.RecordBatch.from_pylist([{"length": k, "n": n, "largest": m} for k, (n, m) in found.items()], pa.schema([("length", pa.int32()), ("n", pa.int64()), ("largest", pa.int64())]))

    sums = rows.mapInArrow(run, "length int, n long, largest long").groupBy("length")
    return sums.agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).where("n > 0")


def primes_for(bound: int) -> list[int]:
    """Primes, falling from PRIMES_BELOW, whose product is above twice the bound: residues tell all sums within it."""
    found: list[int] = []
    candidates = (p for p in count(PRIMES_BELOW - 1, -2) if all(p % q for q in range(3, math.isqrt(p) + 1, 2)))
    while math.prod(found) <= 2 * bound:
        found.append(next(candidates))
    return found


def residue_sums(rows: DataFrame, length: int, primes: list[int]) -> DataFrame:
    """i, j (i <= j), r0, r1, ...: sums, over all rows with a leading one, of the products of entries i and j, a residue sum
    for each prime."""
    upper = np.triu_indices(length + 1)
    names = [f"r{k}" for k in range(len(primes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(primes), length + 1, length + 1), np.int64)
        for batch in batches:
            _, x = of_length(batch, length)
            for at in range(0, len(x), ROWS):
                part = np.insert(x[at : at + ROWS], 0, 1, axis=1)
                for k, p in enumerate(primes):
                    r = (part % p).astype(np.float64)
                    sums[k] = (sums[k] + (r.T @ r).astype(np.int64)) % p
        if sums.any():
            cells = [pa.array(u.astype(np.int32)) for u in upper] + [pa.array(s[upper]) for s in sums]
            yield pa.RecordBatch.from_arrays(cells, ["i", "j", *names])

    schema = ", ".join(["i int, j int", *[f"{c} long" for c in names]])
    return rows.mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])


def from_residues(residues: list[int], primes: list[int]) -> int:
    """The one whole number nearest to zero with these residues (sums of them will do)."""
    product = math.prod(primes)
    found = sum(r * (product // p) * pow(product // p, -1, p) for r, p in zip(residues, primes, strict=True)) % product
    return found if 2 * found <= product else found - product


@dataclass(frozen=True)
class Fit:
    """n and the sums of the fit list, its leading eigenvalues (falling), unit vectors (columns), the covariance's trace."""

    length: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def alive(self) -> np.ndarray:
        top = self.values[0] if len(self.values) else 0.0
        return self.values > max(top, 0.0) * ZERO * self.length


def fitted(rows: DataFrame, components: int) -> Fit | None:
    """The fit over all rows (id, vector) that remain; None where none does."""
    first = lengths_of(rows).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not first:
        return None
    length, n, largest = first[0]
    primes = primes_for(n * max(largest, 1) ** 2)
    exact = np.empty((length + 1, length + 1), object)
    for i, j, *residues in residue_sums(rows, length, primes).toLocalIterator():
        exact[i, j] = exact[j, i] = from_residues(residues, primes)
    n, sums, scatter = exact[0, 0], exact[0, 1:], exact[1:, 1:]
    centred = n * scatter - np.multiply.outer(sums, sums)  # whole numbers
    covariance = np.array([[c / (n * n) for c in row] for row in centred])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(order))])
    return Fit(length, n, tuple(sums), values[order], vectors * signs, float(sum(int(c) for c in centred.diagonal()) / (n * n)))


def deviations(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n x - S, exact: longs, or Python's integers where they have no place."""
    base = np.array([s // fit.n for s in fit.sums], np.int64)
    rest = [s % fit.n for s in fit.sums]
    centred = x.astype(object) - base if max(map(abs, fit.sums)) >> ENTRY_BITS - 1 else x - base
    if len(x) and fit.n * (int(abs(centred).max()) + 1) >> ENTRY_BITS:
        return centred.astype(object) * fit.n - np.array(rest, object)
    return centred.astype(np.int64) * fit.n - np.array(rest, np.int64)


def squared_lengths(d: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if d.dtype == object:
        return (d * d).sum(axis=1).tolist()
    limbs = [d & ((1 << LIMB) - 1), (d >> LIMB) & ((1 << LIMB) - 1), d >> 2 * LIMB]
    total: list[int] = [0] * len(d)
    for a in range(3):
        for b in range(a, 3):
            part = (limbs[a] * limbs[b]).sum(axis=1).tolist()
            weight = (1 if a == b else 2) << LIMB * (a + b)
            total = [t + weight * s for t, s in zip(total, part, strict=True)]
    return total


def projected(d: np.ndarray, fit: Fit) -> np.ndarray:
    """The whitened rows: mean-free x on the components, over the root of the eigenvalue; nan where that is zero."""
    with np.errstate(all="ignore"):
        scale = np.where(fit.alive, 1 / np.sqrt(np.where(fit.alive, fit.values, 1.0)), np.nan)
    return (d / fit.n).astype(np.float64) @ fit.vectors * scale


def identity_error(rows: DataFrame, fit: Fit) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    alive = int(fit.alive.sum())
    if not alive:
        return None
    upper = np.triu_indices(alive + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((alive + 1, alive + 1))
        for batch in batches:
            _, x = of_length(batch, fit.length)
            w = np.insert(projected(deviations(x, fit), fit)[:, fit.alive], 0, 1.0, axis=1)
            sums += w.T @ w
        if sums.any():
            yield pa.RecordBatch.from_arrays([*[pa.array(u.astype(np.int32)) for u in upper], pa.array(sums[upper])], ["i", "j", "s"])

    moments = np.zeros((alive + 1, alive + 1))
    for i, j, s in rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        moments[i, j] = moments[j, i] = s / fit.n
    means = moments[0, 1:]
    return float(np.abs(moments[1:, 1:] - np.outer(means, means) - np.eye(alive)).max())


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact: a row for each remaining row
    and component."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fit = fitted(rows, components)
    if fit is None:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(rows, fit)
    k = len(fit.values)
    explained = [float(v) / fit.trace if fit.trace > 0 else None for v in fit.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = of_length(batch, fit.length)
            if not len(x):
                continue
            d = deviations(x, fit)
            exact = squared_lengths(d)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            w = projected(d, fit).ravel()
            yield pa.RecordBatch.from_arrays([
                ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, fit.n)),
                pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).take(each), pa.array(w, mask=np.isnan(w)),
                pa.array(explained * len(x), pa.float64()), pa.array([error] * (len(x) * k), pa.float64()), pa.array(map(str, exact), pa.string()).take(each),
            ], [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
