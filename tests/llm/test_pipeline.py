import pytest

import corpus_pipeline
from tests.llm import test_decontaminate, test_ngram_join
from tests.llm.conftest import SCHEMA, documents, frame, sentence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = f"file://{tmp_path_factory.mktemp('tables')}"
    rows = documents()
    frame(spark, rows).write.parquet(f"{top}/documents.parquet")
    items = [(1, " ".join(rows[50][1].split()[3:18])), (2, "never seen words of a benchmark item that nobody ever copied")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, rows, items


def test_stages(spark, folder):
    top, rows, items = folder
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{top}/documents.parquet")
    kept = stages["language ID"](spark, docs, top)
    assert kept.columns == docs.columns
    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((r[0], r[1]) for r in letters), key=repr)

    single = stages["n-gram Jaccard join"](spark, docs, top)
    assert single.columns == docs.columns
    want = {d for d, _, c in test_ngram_join.expected(rows) if d is not None and d == c}
    ids = [r.doc_id for r in single.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2

    clean = stages["benchmark decontamination"](spark, docs, top)
    dirty = {r[0] for r in test_decontaminate.expected(rows, items) if r[5]}
    assert 50 in dirty and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - dirty

    drawn = stages["mixing sources to target weights"](spark, docs, top)
    assert drawn.columns == docs.columns and 0 < drawn.count() <= len(rows)


def test_run(spark, folder):
    top, *_ = folder
    found = corpus_pipeline.run(spark, top).collect()
    ids = [r.doc_id for r in found if r.doc_id is not None]
    assert found and len(set(ids)) == len(ids) and 50 not in ids
    assert min(r.start for r in found) == 0 and sum(r.n_tokens for r in found) == max(r.start + r.n_tokens for r in found)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, sentence(__import__("random").Random(1), "en", 20))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    import random

    rng = random.Random(11)
    a, b, c, d = (sentence(rng, "en", 40) for _ in range(4))
    near = " ".join([*a.split()[:-1], "changed"])
    rows = [(1, a, "en", "s"), (2, near, "en", "s"), (2, b, "en", "s"), (3, c, "en", "s"), (3, d, "en", "s"), (3, d, "en", "s"), (4, "", "en", "s"), (4, None, "en", "s"), (4, "", "en", "s"), (None, a, "en", "s")]
    docs = frame(spark, rows)
    kept = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (2, b), (3, c), (3, d), (4, ""), (4, None), (None, a)], key=repr)
