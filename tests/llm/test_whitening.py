import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n long, component string"


def frame(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, 5, "x") for i, v in vectors], schema).repartition(3)


def plain(vectors, length):
    """(n, sums, covariance) in whole numbers and fractions."""
    xs = [[math.floor(c * 1024) + 100000 for c in v] for _, v in vectors if v is not None and len(v) == length and all(c is not None and math.isfinite(c) for c in v)]
    n = len(xs)
    sums = [sum(x[j] for x in xs) for j in range(length)]
    cov = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in xs), n**3) for j in range(length)] for i in range(length)]
    return xs, n, sums, cov


def vectors_of(rng, n, length):
    base = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(3)]
    return [(i, [sum(w * b[j] for w, b in zip([rng.gauss(0, 2), rng.gauss(0, 1), 0.5], base, strict=True)) + rng.gauss(0, 0.1) for j in range(length)]) for i in range(n)]


@pytest.mark.parametrize("length", [3, 12])
def test_rows_are_those_of_exact_arithmetic(spark, length):
    rng = random.Random(length)
    vectors = vectors_of(rng, 200, length)
    vectors += [(7, vectors[7][1])] * 60 + [(None, vectors[3][1])]  # a hot vector, a row without id
    odd = [(900, None), (901, []), (902, [None] * length), (903, [float("nan")] * length), (904, [float("inf")] + [0.0] * (length - 1)), (905, [1.0] * (length + 1)), (906, [1e300] * length)]
    xs, n, sums, cov = plain(vectors, length)
    got = whitening.whitened(frame(spark, vectors + odd)).collect()
    k = min(8, length)
    assert len(got) == n * k and {r.n for r in got} == {n}
    want = defaultdict(int)
    for (i, _), x in zip(vectors, xs, strict=True):
        want[i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))] += k
    found = defaultdict(int)
    for r in got:
        found[r.vec_id, r.deviation] += 1
        assert r.deviation_exact == str(r.deviation)
    assert found == want
    values = np.linalg.eigvalsh(np.array([[float(c) for c in row] for row in cov]))[::-1]
    trace = float(sum(cov[j][j] for j in range(length)))
    for c in range(1, k + 1):
        w = np.array([r.whitened for r in got if r.component == c])
        assert abs(w.mean()) < 1e-9 and abs((w * w).mean() - 1) < 1e-9
        (share,) = {r.explained for r in got if r.component == c}
        assert share == pytest.approx(values[c - 1] / trace, rel=1e-9)
    (error,) = {r.identity_error for r in got}
    assert 0 <= error < 1e-9


def test_components_are_the_eigenvectors(spark):
    vectors = vectors_of(random.Random(5), 150, 6)
    xs, n, sums, cov = plain(vectors, 6)
    exact = np.array([[float(c) for c in row] for row in cov])
    values, basis = np.linalg.eigh(exact)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    want = (np.array(xs) - mean) @ basis[:, ::-1] / np.sqrt(values[::-1])
    got = {(r.vec_id, r.component): r.whitened for r in whitening.whitened(frame(spark, vectors)).collect()}
    for c in range(6):
        w = np.array([got[i, c + 1] for i in range(150)])
        assert np.allclose(w, want[:, c], atol=1e-8) or np.allclose(w, -want[:, c], atol=1e-8)


def test_sums_that_doubles_and_longs_cannot_hold_are_exact(spark):
    rng = random.Random(9)
    vectors = [(i, [rng.uniform(-1, 1) * 2.0**e for e in (0, 30, 50)]) for i in range(40)]
    xs, n, sums, cov = plain(vectors, 3)
    fit = whitening.fitted(frame(spark, vectors).selectExpr("vec_id", "embedding as vector"), 3)
    assert (fit.n, list(fit.sums)) == (n, sums)
    assert fit.trace == pytest.approx(float(sum(cov[j][j] for j in range(3))), rel=1e-15)
    got = {r.vec_id: r for r in whitening.whitened(frame(spark, vectors)).collect()}
    for (i, _), x in zip(vectors, xs, strict=True):
        d = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        assert got[i].deviation_exact == str(d) and got[i].deviation == (d if d < 2**63 else None)


def test_residues_give_whole_numbers_back():
    rng = random.Random(3)
    for bits in (1, 18, 40, 90, 200):
        primes = whitening.primes_for(1 << bits)
        assert all(p < whitening.PRIMES_BELOW for p in primes) and len(set(primes)) == len(primes)
        for _ in range(50):
            v = rng.randint(-(1 << bits), 1 << bits)
            assert whitening.from_residues([v % p + p * rng.randint(0, 5) for p in primes], primes) == v
    assert whitening.ROWS * whitening.PRIMES_BELOW**2 <= 2**53


def test_squares_of_longs_are_exact():
    rng = random.Random(4)
    d = np.array([[rng.randint(-(1 << 62), 1 << 62) for _ in range(9)] for _ in range(20)], np.int64)
    want = [sum(int(v) ** 2 for v in row) for row in d]
    assert whitening.squared_lengths(d) == want == whitening.squared_lengths(d.astype(object))


def test_no_variance_and_no_rows(spark):
    got = whitening.whitened(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(got) == 4 and all((r.deviation, r.whitened, r.explained, r.identity_error) == (0, None, None, None) for r in got)
    flat = whitening.whitened(frame(spark, [(i, [float(i), 2.0]) for i in range(5)])).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True} and flat[0].identity_error < 1e-9
    for rows in ([], [(1, None), (2, [None]), (3, [float("nan")])]):
        empty = whitening.whitened(frame(spark, rows))
        assert empty.collect() == [] and ", ".join(f"{c} {t}" for c, t in empty.dtypes).replace("bigint", "long") == whitening.SCHEMA


def test_floats_and_other_names(spark):
    df = spark.createDataFrame([(i, [i * 0.5, 1.0 - i]) for i in range(4)], "k int, v array<float>")
    assert whitening.whitened(df, "k", "v", 1).count() == 4
