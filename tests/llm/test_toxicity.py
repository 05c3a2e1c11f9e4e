import random
import zlib

import numpy as np

from tessera.llm import toxicity
from tests.llm.conftest import frame, sentence


def labelled(n=260, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = sentence(rng, "en", rng.randint(15, 60)).split()
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grumpf", "grumpfish", "zonk", "zonker"]))
        rows.append((i, " ".join(words), "en", "src0"))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_documents_and_offsets(spark):
    rows, labels = labelled()
    docs = frame(spark, [*rows, (900, None, "en", "s"), (901, "", "en", "s"), (None, "zonk grumpf zonk", "en", "s"), (3, rows[3][1], "en", "s")])
    marks = spark.createDataFrame([*labels, (1, None, None), (None, 1, 1), labels[0]], "doc_id long, quality long, toxic long")
    found = toxicity.toxicity(docs, marks).collect()
    assert len(found) == len(rows) + 4
    by = {r.doc_id: r for r in found}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(by[i].held_out for i in held)
    assert all(by[i].predicted == (i % 4 == 0) == (by[i].score >= 0.5) for i in held)
    text = rows[8][1]
    words = {text[s.start : s.end] for s in by[8].spans}
    assert words and all(w.startswith(("grumpf", "zonk")) for w in words)
    assert by[None].predicted == 1 and by[900].predicted == 0 and by[901].score == by[900].score


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows, labels = labelled(120)
    docs = frame(spark, rows)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    schema = "doc_id long, quality long, toxic long"
    pick = lambda m: sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, spark.createDataFrame(m, schema)).collect())
    assert pick(labels) == pick(other)


def test_forward_backward_against_all_taggings():
    rng = np.random.default_rng(3)
    t = rng.normal(size=(2, 2))
    sizes = np.array([1, 4, 0, 6])
    e = rng.normal(size=sizes.sum()) * 2
    got = toxicity.odds(e, sizes, t)
    pairs = toxicity.pair_marginals(e, sizes, t, got)
    at, expected_pairs = 0, np.zeros((2, 2))
    for n in sizes:
        own = e[at : at + n]
        total, ones, seen = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(own[k] * y[k] for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            ones += w * np.array(y)
            for k in range(n - 1):
                seen[y[k], y[k + 1]] += w
        if n:
            p = got[at : at + n] / (1 + got[at : at + n])
            assert np.allclose(p, ones / total)
            expected_pairs += seen / total
        at += n
    assert np.allclose(pairs, expected_pairs)


def test_one_kind_of_label_and_empty_tables(spark, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert toxicity.toxicity(no_docs, none).collect() == []
    one = frame(spark, [(i, f"word{i} text", "en", "s") for i in range(12)])
    clean = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality long, toxic long")
    assert {r.predicted for r in toxicity.toxicity(one, clean).collect()} == {0}


def test_document_scores_against_all_taggings(spark):
    """The score column of the operator's own scoring, from marginals that are summed over all taggings."""
    rng = np.random.default_rng(5)
    weights, t = np.zeros(toxicity.N_FEATURES), rng.normal(size=(2, 2))
    vocabulary = [f"word{i}" for i in range(12)]
    for w in vocabulary:
        weights[toxicity.features(w)] = rng.normal(size=10) * 0.4
    tagger = toxicity.Tagger(weights, t, (0.3, 0.7, -0.4))
    texts = ["", "...", *(" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 5, 8, 9))]
    rows = spark.createDataFrame([(i, False, x) for i, x in enumerate(texts)], "doc_id long, held_out boolean, text string")
    got = {r.doc_id: r for r in rows.mapInArrow(toxicity.scoring(tagger), toxicity.SCORES).collect()}
    for i, text in enumerate(texts):
        words = toxicity.WORDS.findall(text)
        own = [float(tagger.weights[toxicity.features(w)].sum()) for w in words]
        total, ones = 0.0, np.zeros(len(words))
        for code in range(2 ** len(words)):
            y = [(code >> k) & 1 for k in range(len(words))]
            w = np.exp(sum(e * b for e, b in zip(own, y, strict=True)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            total += w
            ones += w * np.array(y)
        p = ones / total
        top = float(np.clip(np.log(max(p / (1 - p))), -10, 10)) if len(words) else -10.0
        count = float(np.log1p(sum(x for x in p if x > 0.05)))
        assert np.isclose(got[i].score, 1 / (1 + np.exp(-(0.3 * top + 0.7 * count - 0.4))), atol=1e-6), text
        assert [text[s.start : s.end] for s in got[i].spans] == [w for w, x in zip(words, p, strict=True) if x >= 0.5]


def test_contradictory_labels_repeated_rows_clashing_names_and_a_long_text(spark):
    rows, labels = labelled()
    schema = "doc_id long, quality long, toxic long, text string, score double"
    marks = [(i, q, t, "zonk", 1.0) for i, q, t in labels]
    marks += [(i, q, 0, "x", 0.0) for i, q, t in labels if t]  # one says toxic, another not: toxic counts
    long = " ".join(rows[1][1].split() * 1500)
    docs = frame(spark, [*rows, *[rows[4]] * 50, (5000, long, "en", "s"), (5001, long + " grumpf zonk grumpf", "en", "s")])
    found = toxicity.toxicity(docs, spark.createDataFrame(marks, schema)).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + 52
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].predicted == (i % 4 == 0) for i in held)
    words = {(long + " grumpf zonk grumpf")[s.start : s.end] for s in by[5001].spans}
    assert by[5000].spans == [] and words == {"grumpf", "zonk"}
