"""The best rows for each question among hashed vectors: pairs that cannot win are screened out, the others are scored exactly.

A question of few terms has few places that are not 0, so its products with all rows of a part are sums of few columns. Columns are
rounded to 16 bits; a pair whose sum, with all that rounding can add, stays below the question's best so far cannot win. Questions of many
terms and small parts are screened by matrix products in single precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np

DIGITS = 9
#: Rows and questions of a matrix product.
ROWS = 2048
#: Above what the rounding of single precision adds up to in a cosine.
SLACK = 1e-4
#: Pairs that are scored exactly at once, and that wait for it.
PAIRS, WAITING = 8192, 1 << 17
#: Parts of fewer rows, and questions of a larger sum of absolute values or length, are left to matrix products.
LEAST_ROWS, NARROW, LONGEST = 4096, 64, 30
#: What 1 is in 16 bits; LONGEST times that fits. Rows whose columns are made at once.
ONE, SOME = 1024, 256


class Sparse(NamedTuple):
    """Whole-number vectors: `place` and `value` of what is not 0, from `at[i]` to `at[i + 1]` those of the vector i."""

    at: np.ndarray
    place: np.ndarray
    value: np.ndarray
    dim: int


def sparse(parts: Iterable[np.ndarray], dim: int) -> Sparse:
    """parts: matrices whose rows are the vectors."""
    at, place, value = [np.zeros(1, np.int64)], [np.empty(0, np.int16)], [np.empty(0, np.int32)]
    for m in parts:
        r, c = np.nonzero(m)
        at.append(at[-1][-1] + np.bincount(r, minlength=len(m)).cumsum())
        place.append(c.astype(np.int16))
        value.append(m[r, c].astype(np.int32))
    return Sparse(np.concatenate(at), np.concatenate(place), np.concatenate(value), dim)


def few_copies(m: np.ndarray, k: int) -> np.ndarray:
    """The rows (in order) without those that have k equal ones before them."""
    code = m.astype(np.int64) @ np.random.default_rng(1).integers(1, 1 << 62, m.shape[1])
    order = np.argsort(code, kind="stable")
    at = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
    sizes = np.diff(np.r_[at, len(order)])
    late = np.arange(len(order)) - np.repeat(at, sizes) >= k
    first = np.repeat(order[at], sizes)[late]
    gone = order[late]
    return np.setdiff1d(np.arange(len(m)), gone[(m[gone] == m[first]).all(axis=1)], assume_unique=True)


def finder(q: np.ndarray | Sparse, k: int, distinct: bool = False) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """rows -> (questions, rows, scores) that hold the best k of all rows so far, of equal scores the first rows; to be called part by part.

    distinct: no vector stands more than k times in all parts.
    """
    q = q if isinstance(q, Sparse) else sparse([q], q.shape[1])
    n = np.diff(q.at)
    owner, value = np.repeat(np.arange(len(n)), n), q.value.astype(np.float64)
    q2, l1 = (np.bincount(owner, x, len(n)) for x in (value * value, np.abs(value)))
    length = np.sqrt(q2)
    said, silent = np.flatnonzero(n), np.flatnonzero(n == 0)
    few_terms = (l1[said] <= NARROW) & (length[said] <= LONGEST)
    narrow, wide = said[few_terms], said[~few_terms]
    top = np.full((len(n), k), -np.inf)  # the best exact scores so far

    def unit_questions(own: np.ndarray) -> np.ndarray:
        m = np.zeros((len(own), q.dim), np.float32)
        at = np.concatenate([np.arange(q.at[i], q.at[i + 1]) for i in own])
        m[np.repeat(np.arange(len(own)), n[own]), q.place[at]] = value[at] / np.repeat(length[own], n[own])
        return m

    def find(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        few = np.arange(len(m)) if distinct else few_copies(m, k)
        m = m if distinct else m[few]
        m2 = np.concatenate([np.square(m[at : at + ROWS], dtype=np.float64).sum(axis=1) for at in range(0, len(m), ROWS)])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def unit(rows: np.ndarray) -> np.ndarray:
            return (m[rows] / np.sqrt(np.where(m2[rows] == 0, 1.0, m2[rows]))[:, None]).astype(np.float32)

        def exact(a: np.ndarray, r: np.ndarray) -> np.ndarray:
            ends = n[a].cumsum()
            i = np.arange(ends[-1]) + np.repeat(q.at[a] - (ends - n[a]), n[a])
            dots = np.add.reduceat(value[i] * m[np.repeat(r, n[a]), q.place[i]], ends - n[a])
            return np.round(dots / np.where(m2[r] == 0, 1.0, np.sqrt(q2[a] * m2[r])), DIGITS)

        def best(a: np.ndarray, r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
            """The best k of each question, in order, and their places."""
            order = np.lexsort((r, -s, a))
            a, r, s = a[order], r[order], s[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            return tuple(x[place < k] for x in (a, r, s, place))

        def keep(a: np.ndarray, r: np.ndarray) -> None:
            s = np.concatenate([np.empty(0), *(exact(a[at : at + PAIRS], r[at : at + PAIRS]) for at in range(0, len(a), PAIRS))])
            good = s >= top[a, -1]
            a, r, s, place = best(a[good], r[good], s[good])
            own, at = np.unique(a, return_inverse=True)
            new = np.full((len(own), k), -np.inf)
            new[at, place] = s
            top[own] = -np.sort(-np.hstack([top[own], new]), axis=1)[:, :k]
            found.append((a, r, s))

        def by_product(own: np.ndarray, rows: np.ndarray) -> None:
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                u = unit(some).T
                for b in range(0, len(own), ROWS):
                    asked = own[b : b + ROWS]
                    near = unit_questions(asked) @ u
                    least = top[asked, -1] - SLACK
                    if len(some) > k and np.isinf(least).any():
                        least = np.maximum(least, np.partition(near, len(some) - k, axis=1)[:, len(some) - k] - 2 * SLACK)
                    a, r = np.nonzero(near >= least.astype(np.float32)[:, None])
                    keep(asked[a], some[r])

        def by_sums(own: np.ndarray) -> None:
            columns = np.empty((q.dim, len(m)), np.int16)
            for at in range(0, len(m), SOME):
                by = ONE / np.sqrt(np.where(m2[at : at + SOME] == 0, 1.0, m2[at : at + SOME]))
                columns[:, at : at + SOME] = np.rint(m[at : at + SOME] * by[:, None]).astype(np.int16).T
            of, total, times = list(columns), np.empty(len(m), np.int16), np.empty(len(m), np.int16)
            slack = 0.501 * l1[own] + 0.01
            known = top[own, -1] > -np.inf
            least = np.floor(ONE * length[own] * (np.where(known, top[own, -1], 0) - 1e-8) - slack)
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            for i, low, has, free in zip(own.tolist(), least.tolist(), known.tolist(), slack.tolist(), strict=True):
                total.fill(0)
                for j, v in zip(q.place[q.at[i] : q.at[i + 1]].tolist(), q.value[q.at[i] : q.at[i + 1]].tolist(), strict=True):
                    if v == 1:
                        np.add(total, of[j], total)
                    elif v == -1:
                        np.subtract(total, of[j], total)
                    else:
                        np.add(total, np.multiply(of[j], np.int16(v), times), total)
                if not has:
                    low = (total.max() if k == 1 else np.partition(total, len(m) - k)[len(m) - k]) - 2 * free
                hit = np.flatnonzero(total >= np.int16(max(np.floor(low), -ONE * 32)))
                if len(hit):
                    waiting.append((np.full(len(hit), i), hit))
                    held += len(hit)
                if held > WAITING:
                    keep(*map(np.concatenate, zip(*waiting, strict=True)))
                    waiting, held = [], 0
            if held:
                keep(*map(np.concatenate, zip(*waiting, strict=True)))

        every = np.arange(len(m))
        summed = narrow if len(m) >= max(LEAST_ROWS, k) else narrow[:0]
        by_product(wide if len(summed) else said, every)
        if len(summed):
            by_sums(summed)
        none = min(k, len(m))
        found.append((np.repeat(silent, none), np.tile(np.arange(none), len(silent)), np.zeros(none * len(silent))))
        a, r, s, _ = best(*map(np.concatenate, zip(*found, strict=True)))
        return a, few[r], s

    return find
