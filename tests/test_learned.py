import random
from collections import Counter

import numpy as np
import pytest

from tessera.operators import learned, retrieval

SCHEMA = "doc_id long, text string, embedding string"


def made(n, seed, words=24):
    rng = random.Random(seed)
    return [(k, " ".join(f"w{rng.choice('abc')}{min(int(rng.expovariate(0.15)), words - 1)}" for _ in range(rng.randint(3, 25)))) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)


def plain(rows, window, least):
    """Document vectors by a dense matrix and a whole decomposition."""
    texts = [(t or "").split() for _, t in rows]
    docs = Counter(w for t in texts for w in set(t))
    said = Counter(w for t in texts for w in t)
    words = sorted(w for w in docs if docs[w] >= least)
    at = {w: i for i, w in enumerate(words)}
    c = np.zeros((len(words), len(words)))
    for t in texts:
        for i, a in enumerate(t):
            for b in t[i + 1 : i + 1 + window]:
                if a in at and b in at:
                    c[at[a], at[b]] += 1
                    c[at[b], at[a]] += 1
    r = c.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.log(c * c.sum() / np.outer(r, r))
    m = np.where(np.isfinite(m) & (m > 0), m, 0.0)
    values, vectors = np.linalg.eigh(m)
    keep = values > values.max() * 1e-9
    u = vectors[:, keep] * np.sqrt(values[keep])
    total = sum(said[w] for w in words)
    out = np.array([sum((learned.RARE / (learned.RARE + said[w] / total) * u[at[w]] for w in t if w in at), np.zeros(u.shape[1])) for t in texts])
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1, length)


def vectors_of(df):
    return {r.doc_id: np.array(r.embedding) for r in df.collect()}


@pytest.mark.parametrize(("window", "least"), [(4, 1), (2, 3)])
def test_against_a_whole_decomposition(spark, window, least):
    """As the matrix has fewer directions than are looked for, the range is exact and so are all products of vectors."""
    rows = made(60, window) + [(100, None), (101, ""), (102, "neverseen")]
    got = vectors_of(learned.learned_vectors(frame(spark, rows), dim=80, window=window, least=least))
    want = plain(rows, window, least)
    ours = np.array([got[k] for k, _ in rows])
    assert ours.shape == (len(rows), 80) and np.allclose(ours @ ours.T, want @ want.T, atol=1e-6)
    assert not got[100].any() and not got[101].any()


def test_fewer_directions_keep_neighbours(spark):
    rng = random.Random(5)
    topics = [[f"t{t}x{k}" for k in range(12)] for t in range(5)]
    rows = [(k, " ".join(rng.choice(topics[k % 5]) for _ in range(20))) for k in range(100)]
    df = frame(spark, rows)
    found = learned.learned_vectors(df, dim=6)
    got = vectors_of(found)
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 and len(v) == 6 for v in got.values())
    near = retrieval.top_k_dense(found, "doc_id", found.withColumnRenamed("doc_id", "qid"), "qid", 5).collect()
    assert sum(r.doc_id % 5 == r.qid % 5 for r in near) / len(near) > 0.95  # a fifth by chance


def test_dealing_does_not_matter_and_repeated_rows_stay(spark):
    rows = made(30, 9) + [(3, "wa1 wb2 wa1 wc3"), (3, "wa1 wb2 wa1 wc3"), (None, "wa1 wb2")]
    a, b = (learned.learned_vectors(frame(spark, rows).repartition(n), dim=5, least=1) for n in (1, 7))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, [round(x, 5) for x in r.embedding])
    one, two = (sorted(x.collect(), key=key) for x in (a, b))
    assert len(one) == 33 and all(np.allclose(x.embedding, y.embedding, atol=1e-5) and x.doc_id == y.doc_id for x, y in zip(one, two, strict=True))


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "the of and")], [(1, "alone")]):
        got = vectors_of(learned.learned_vectors(frame(spark, rows), dim=4))
        assert {k: v.tolist() for k, v in got.items()} == {k: [0.0] * 4 for k, _ in rows}


def test_counts_are_small_and_whole(spark, tmp_path):
    """Several blocks of words: pairs as counted one by one, in few bytes each, and the product with random signs as Spark's hash gives them."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    size, window = 2 * learned.BLOCK + 100, 3
    docs = [rng.zipf(1.3, 400) % (size + 1) - 1 for _ in range(300)]
    df = spark.createDataFrame([(d.tolist(),) for d in docs], "codes array<int>").repartition(3)
    want = Counter()
    for d in docs:
        for step in range(1, window + 1):
            want.update((min(a, b), max(a, b)) for a, b in zip(d[:-step].tolist(), d[step:].tolist(), strict=True) if min(a, b) >= 0)
    counts = learned.counts_of(df, size, window).cache()
    got, held = {}, 0
    for r in counts.collect():
        keys, n = learned.unpacked(bytes(r.data), r.n)
        held += len(r.data)
        got |= {(r.own * learned.BLOCK + k // learned.BLOCK, r.other * learned.BLOCK + k % learned.BLOCK): c for k, c in zip(keys.tolist(), n.tolist(), strict=True)}
    assert got == dict(want) and held < 6 * len(want)
    ids = np.arange(-5, 5, dtype=np.int64) * 10**15
    ours = spark.createDataFrame([(int(i),) for i in ids], "i long").select("i", *[(F.xxhash64("i", F.lit(c)) % 2 == 0).alias(f"c{c}") for c in range(3)]).collect()
    assert {r.i: [1.0 if x else -1.0 for x in r[1:]] for r in ours} == dict(zip(ids.tolist(), learned.signs(ids, 3).tolist(), strict=True))
