import random

import numpy as np
import pytest

from tessera.operators import graph_index, retrieval
from tessera.operators.graph_index import GraphIndex

SCHEMA = "vec_id long, embedding array<float>"


def clustered(n, length=16, centres=12, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, length))
    return [(i, (middle[i % centres] + 0.4 * rng.normal(size=length)).astype(np.float32).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(rows, asked, k):
    m = np.array([v for _, v in rows], np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    ids = np.array([i for i, _ in rows])
    out = {}
    for qid, v in asked:
        s = np.round(m @ (np.array(v) / max(np.linalg.norm(v), 1e-30)), 9)
        out[qid] = [int(ids[j]) for j in np.lexsort((ids, -s))[:k]]
    return out


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(graph_index, "CELL_ROWS", 200)
    monkeypatch.setattr(graph_index, "SHARD_ROWS", 1200)
    monkeypatch.setattr(graph_index, "WHOLE", 20)
    monkeypatch.setattr(graph_index, "QUESTIONS", 16)


def test_search_finds_the_neighbours_and_reopens(spark, tmp_path, small_cells):
    rows = clustered(3000)
    df = frame(spark, rows)
    GraphIndex.build(df, "vec_id", f"{tmp_path}/index")
    index = GraphIndex.open(spark, f"{tmp_path}/index")
    assert len(index.centres) == 15 and 1 <= index.probes < 15
    asked = [r for r in rows if r[0] % 50 == 0]
    got = {}
    for r in index.search(frame(spark, asked).withColumnRenamed("vec_id", "qid"), "qid", 4).collect():
        got.setdefault(r.qid, {})[r.rank] = (r.id, r.score)
    want = brute(rows, asked, 4)
    assert set(got) == set(want) and all(sorted(v) == [1, 2, 3, 4] for v in got.values())
    assert all(got[q][1] == (q, pytest.approx(1, abs=1e-6)) for q in got)
    hits = sum(len({i for i, _ in got[q].values()} & set(want[q])) for q in want)
    assert hits >= 0.9 * 4 * len(want)
    asked_df = frame(spark, asked).withColumnRenamed("vec_id", "qid")
    (measured,) = graph_index.recall(index.search(asked_df, "qid"), retrieval.top_k_dense(df, "vec_id", asked_df, "qid"), "qid", "vec_id").collect()
    assert (measured.questions, measured.wanted) == (60, 240) and measured.recall == pytest.approx(hits / 240)


def test_every_row_is_in_the_index_once(spark, tmp_path, small_cells):
    rows = clustered(900) + [(5000 + i, [1.0] * 16) for i in range(600)]  # a hot vector of more rows than a shard's mean
    odd = [(1, None), (2, []), (3, [None] * 16), (4, [float("nan")] * 16), (5, [1.0] * 3), (6, [float("inf")] * 16)]
    index = GraphIndex.build(frame(spark, rows + odd), "vec_id", f"{tmp_path}/index")
    graphs = spark.read.parquet(f"{index.path}/graphs")
    assert sorted(i for r in graphs.collect() for i in r.ids) == sorted(i for i, _ in rows)
    found = [r.id for r in index.search(frame(spark, [(7, [2.0] * 16)]).withColumnRenamed("vec_id", "qid"), "qid", 5).orderBy("rank").collect()]
    assert found == [5000, 5001, 5002, 5003, 5004]
    assert index.search(frame(spark, odd).withColumnRenamed("vec_id", "qid"), "qid").collect() == []


def test_a_hot_vector_is_once_in_a_sample(spark):
    rows = frame(spark, [(k, [1.0, 2.0]) for k in range(500)] + [(k, [float(k), 1.0]) for k in range(500, 1000)]).withColumnRenamed("embedding", "v")
    found = [tuple(r.v) for r in graph_index.some_vectors(rows, 1000, 10_000, 0).collect()]
    assert len(found) == len(set(found)) == 501
    assert 20 < graph_index.some_vectors(rows, 1000, 100, 0).count() < 120


def test_rows_that_are_added_are_found(spark, tmp_path, small_cells):
    rows = clustered(800)
    index = GraphIndex.build(frame(spark, rows[:600]), "vec_id", f"{tmp_path}/index")
    index.add(frame(spark, rows[600:]), "vec_id", "later")
    asked = frame(spark, rows[600:]).withColumnRenamed("vec_id", "qid")
    found = GraphIndex.open(spark, index.path).search(asked, "qid", 1, probes=len(index.centres)).collect()
    assert sum(r.id == r.qid for r in found) >= 0.99 * 200
    with pytest.raises(ValueError, match="length"):
        index.add(frame(spark, [(1, [1.0, 2.0])]), "vec_id", "short")


def test_no_rows(spark, tmp_path):
    index = GraphIndex.build(frame(spark, []), "vec_id", f"{tmp_path}/index")
    assert index.search(frame(spark, [(7, [2.0] * 16)]).withColumnRenamed("vec_id", "qid"), "qid").collect() == []
    one = GraphIndex.build(frame(spark, [(3, [0.0, 0.0])]), "vec_id", f"{tmp_path}/one")
    assert [(r.id, r.score) for r in one.search(frame(spark, [(7, [2.0, 1.0])]).withColumnRenamed("vec_id", "qid"), "qid").collect()] == [(3, 0.0)]


def test_a_graph_reaches_all_its_nodes():
    rng = np.random.default_rng(1)
    far = np.vstack([rng.normal(size=(300, 8)) + 50 * np.eye(8)[k] for k in range(4)])  # four islands
    for vectors in (graph_index.unit(far), graph_index.unit(rng.normal(size=(1, 8))), graph_index.unit(rng.normal(size=(2, 8)))):
        links, starts = graph_index.graph(vectors)
        assert links.shape == (len(vectors), graph_index.LINKS) and links.max() < len(vectors)
        assert all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() for r in links) and not (links == np.arange(len(vectors))[:, None]).any()
        reached, front = set(starts.tolist()), list(starts.tolist())
        while front:
            near = {int(x) for x in links[front.pop()] if x >= 0} - reached
            reached |= near
            front += near
        assert reached == set(range(len(vectors)))


def test_a_walk_finds_the_best():
    rng = np.random.default_rng(2)
    vectors = graph_index.unit(rng.normal(size=(4000, 24)))
    links, starts = graph_index.graph(vectors)
    asked = vectors[:100] + 0.05 * rng.normal(size=(100, 24)).astype(np.float32)
    nodes, scores = graph_index.walked(vectors, links, starts, graph_index.unit(asked), 5)
    exact = (-(graph_index.unit(asked) @ vectors.T)).argsort(axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(nodes.tolist(), exact.tolist(), strict=True)]) >= 4.6
    assert (np.diff(scores, axis=1) <= 0).all()


def test_string_ids_and_doubles(spark, tmp_path):
    rng = random.Random(4)
    df = spark.createDataFrame([(f"k{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(50)], "name string, v array<double>")
    index = GraphIndex.build(df, "name", f"{tmp_path}/index", "v")
    got = index.search(df.withColumnRenamed("name", "q"), "q", 1, "v").collect()
    assert len(got) == 50 and all(r.q == r.id for r in got)
