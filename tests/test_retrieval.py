import zlib

import numpy as np

from tessera.operators import embedding, retrieval, screening

CHUNKS = [
    ("c1", "Staff receive 25 days of annual leave."), ("c2", "Travel costs are refunded within thirty days."), ("c3", "the of and"),
    ("c4", "Passwords have sixteen characters."), ("c5", "Staff receive 25 days of annual leave."), ("c6", ""),
]


def plain_vector(text, dim=512):
    import re

    out = np.zeros(dim)
    for w in re.findall("[a-z0-9]+", text.lower()):
        if w in embedding.STOP_WORDS:
            continue
        h = zlib.crc32((w[:-1] if len(w) > 3 and w.endswith("s") else w).encode())
        out[h % dim] += 1 if (h >> 16) & 1 else -1
    n = np.linalg.norm(out)
    return out / n if n else out


def tables(spark, questions):
    return spark.createDataFrame(CHUNKS, "id string, text string"), spark.createDataFrame(questions, "qid long, text string")


QUESTIONS = [(1, "How many days of leave do staff receive?"), (2, "zebra"), (3, ""), (4, "password characters")]


def test_top_k_fills_up_with_zero_scores_and_breaks_ties(spark):
    chunks, questions = tables(spark, QUESTIONS)
    found = retrieval.top_k_hashed(chunks, "id", questions, "qid", 4).collect()
    for q, text in QUESTIONS:
        own = sorted((r for r in found if r.qid == q), key=lambda r: r["rank"])
        scores = [(-round(float(plain_vector(text) @ plain_vector(t)), 9) + 0.0, i) for i, t in CHUNKS]
        assert [r.id for r in own] == [i for _, i in sorted(scores)[:4]] and [r["rank"] for r in own] == [1, 2, 3, 4]
        assert np.allclose([r.score for r in own], [-s for s, _ in sorted(scores)[:4]], atol=1e-6)


def test_blocks_of_questions_and_partitions_change_nothing(spark, monkeypatch):
    chunks, questions = tables(spark, QUESTIONS)
    pick = lambda c: sorted(tuple(r) for r in retrieval.top_k_hashed(c, "id", questions, "qid", 2).collect())
    whole = pick(chunks)
    monkeypatch.setattr(retrieval, "BLOCK_QUESTIONS", 1)
    monkeypatch.setattr(retrieval, "ROWS", 2)
    assert pick(chunks.repartition(5)) == whole


def test_fewer_chunks_than_k_and_none(spark):
    chunks, questions = tables(spark, QUESTIONS)
    assert retrieval.top_k_hashed(chunks.where("id = 'c1'"), "id", questions, "qid", 4).count() == 4
    empty = retrieval.top_k_hashed(chunks.where("false"), "id", questions, "qid", 4)
    assert empty.count() == 0
    gate = retrieval.similarity_gate(questions, empty, "qid").collect()
    assert len(gate) == 4 and not any(r.passed for r in gate)


def test_gate_is_strict_below(spark):
    chunks, questions = tables(spark, QUESTIONS)
    found = retrieval.top_k_hashed(chunks, "id", questions, "qid", 1)
    best = {r.qid: r.score for r in found.collect()}
    assert {r.qid for r in retrieval.similarity_gate(questions, found, "qid", best[1]).where("passed").collect()} >= {1}
    assert not retrieval.similarity_gate(questions, found, "qid", 1.01).where("passed").count()


def test_sparse_table_has_the_same_vectors(spark):
    chunks, _ = tables(spark, QUESTIONS)
    rows = embedding.hash_embed(chunks, "id").collect()
    for i, text in CHUNKS:
        v = np.zeros(512)
        for r in rows:
            if r.id == i:
                v[r.bucket] = r.value / np.sqrt(r.norm2)
        assert np.allclose(v, plain_vector(text))


def test_dense(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    found = retrieval.top_k_dense(df, "vec_id", df.where("vec_id < 5").withColumnRenamed("vec_id", "qid"), "qid", 3).collect()
    n = m.astype(np.float32).astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    for q in range(5):
        own = [r.vec_id for r in sorted((r for r in found if r.qid == q), key=lambda r: r["rank"])]
        assert own == np.argsort(-(n @ n[q]), kind="stable")[:3].tolist()


def test_model_plug_in(spark):
    chunks, _ = tables(spark, QUESTIONS)

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    rows = embedding.model_embeddings(chunks, "id", load).collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-9 for r in rows)


def test_context(spark):
    rows = spark.createDataFrame([(1, 2, 7, "s", "two"), (1, 1, 3, "s", "one")], "qid long, rank int, page long, source string, text string")
    assert retrieval.context(rows, "qid").first().context == "[1] (page 3, s)\none\n\n[2] (page 7, s)\ntwo"
    assert retrieval.context(rows, "qid", headed=False).first().context == "[1]\none\n\n[2]\ntwo"


def test_ties_are_cut_to_k_in_every_batch():
    scores = np.array([[0.0, 0.0, 0.0, 0.0], [1.0, 0.0, 2.0, 1.0]])
    assert retrieval.best_of(scores, 2).tolist() == [[True, True, False, False], [True, False, True, False]]


def test_screened_pairs_are_the_best_of_all():
    """Part by part, with copies, rows and questions without words: as scoring every pair, and few pairs are handed on."""
    rng = np.random.default_rng(7)
    m = rng.integers(-2, 3, (900, 512)) * (rng.random((900, 512)) < 0.1)
    m[rng.integers(0, 900, 400)] = m[5]
    m[[3, 500]] = 0
    q = np.vstack([m[[5, 9, 3]], rng.integers(-2, 3, (40, 512)) * (rng.random((40, 512)) < 0.05)]).astype(float)
    length = np.sqrt((q * q).sum(axis=1)[:, None] * (m * m).sum(axis=1)[None, :])
    s = np.round((q @ m.T) / np.where(length == 0, 1.0, length), retrieval.DIGITS)
    for k, step in ((1, 300), (4, 128), (4, 3)):
        find, found = retrieval.finder(q, k), []
        for at in range(0, 900, step):
            a, r, x = find(m[at : at + step].astype(float))
            found += [(i, -y, at + j) for i, j, y in zip(a.tolist(), r.tolist(), x.tolist(), strict=True)]
            assert len(a) <= k * len(q)
        for i in range(len(q)):
            assert sorted((y, j) for n, y, j in found if n == i)[:k] == sorted(zip((-s[i]).tolist(), range(900), strict=True))[:k]


def test_sparse_vectors_of_single_keys_are_not_shuffled(spark):
    """Repeated keys are added up, null keys have no vector, and rows with keys of their own stay in their tasks."""
    texts = [*CHUNKS, ("c7", None), (None, "lost words"), ("c1", "Staff leave; thirty parrots."), ("c1", "sixteen parrots")]
    rows = spark.createDataFrame(texts, "id string, text string").repartition(3)
    single = embedding.hash_embed(rows.where("id <> 'c1'"), "id")
    assert "Exchange hashpartitioning" not in single._jdf.queryExecution().toString()
    for df, left in ((rows, texts), (rows.where("id <> 'c1'"), [t for t in texts if t[0] != "c1"])):
        joined = {i: " ".join(t or "" for k, t in left if k == i) for i, _ in left if i}
        found = embedding.hash_embed(df, "id").collect()
        for i, text in joined.items():
            v, want = np.zeros(512), plain_vector(text)
            for r in found:
                if r.id == i:
                    v[r.bucket] = r.value / np.sqrt(r.norm2)
            assert np.allclose(v, want)
        assert {r.id for r in found} <= set(joined) and len({(r.id, r.bucket) for r in found}) == len(found)


def test_sums_of_columns_find_the_best_of_all(monkeypatch):
    """Questions of few and many terms and none, rows with copies, large numbers and none: as scoring every pair."""
    monkeypatch.setattr(screening, "LEAST_ROWS", 100)
    monkeypatch.setattr(screening, "WAITING", 50)
    rng = np.random.default_rng(8)
    m = (rng.integers(-3, 4, (1200, 512)) * (rng.random((1200, 512)) < rng.choice([0.01, 0.1, 0.6], 1200)[:, None])).astype(np.int32)
    m[rng.integers(0, 1200, 200)], m[[7, 700]], m[11, 3] = m[5], 0, 1 << 17
    q = rng.integers(-2, 3, (60, 512)) * (rng.random((60, 512)) < rng.choice([0.003, 0.03, 0.5], 60)[:, None])
    q[:5], q[5, :4] = np.vstack([m[[5, 11, 7, 300]], np.eye(512, dtype=int)[9] * 40]), [9, -8, 1, 2]
    length = np.sqrt((q.astype(float) ** 2).sum(axis=1)[:, None] * (m.astype(float) ** 2).sum(axis=1)[None, :])
    s = np.round((q.astype(float) @ m.T) / np.where(length == 0, 1.0, length), retrieval.DIGITS)
    for k, step, distinct in ((1, 400, False), (1, 1200, True), (4, 300, True), (4, 1200, False)):
        find, found = screening.finder(q, k, distinct), []
        for at in range(0, 1200, step):
            a, r, x = find(m[at : at + step])
            found += [(i, -y, at + j) for i, j, y in zip(a.tolist(), r.tolist(), x.tolist(), strict=True)]
        for i in range(len(q)):
            assert sorted((y, j) for n, y, j in found if n == i)[:k] == sorted(zip((-s[i]).tolist(), range(1200), strict=True))[:k]


def test_copies_are_looked_at_once(spark, monkeypatch):
    """Of many questions each vector is asked once, of equal chunks k are looked at; texts that are null have no words."""
    texts = [t for _, t in CHUNKS] + [None, "zebra " * 40000]
    chunks = spark.createDataFrame([(f"{copy}-{i}", t) for copy in range(5) for i, t in enumerate(texts)], "id string, text string")
    asked = [*(t for _, t in QUESTIONS), None, "thirty days of leave"]
    questions = spark.createDataFrame([(10 * copy + i, t) for copy in range(3) for i, t in enumerate(asked)], "qid long, text string")
    pick = lambda: sorted(tuple(r) for r in retrieval.top_k_hashed(chunks, "id", questions, "qid", 2).collect())
    whole, sizes = pick(), {}

    def noted(df, folder, name, write=retrieval.stored):
        out = write(df, folder, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(retrieval, "stored", noted)
    monkeypatch.setattr(retrieval, "BLOCK_QUESTIONS", 2)
    assert pick() == whole and len(whole) == 2 * len(asked) * 3
    assert sizes["questions"] == 5 and sizes["rows"] == 2 * 5  # "", null and stop words are one vector, and so are the two copies in CHUNKS
