import json
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.sources import store as stores
from tessera.sources.store import Store

SCHEMA = "id string, text string, vector array<float>"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, None if t is None else [float(len(t))]) for i, t in pairs], SCHEMA).repartition(3)


def content(df):
    return sorted((r.id, r.text, tuple(r.vector or ())) for r in df.collect())


def data_names(path):
    return {p.name for p in Path(path, "data").glob("*.parquet")}


def named(path):
    return {f["name"] for p in Path(path, "manifests").glob("*.json") for f in json.loads(p.read_text())}


def test_overlapping_batches_a_failed_write_and_reopening(spark, tmp_path):
    path = f"{tmp_path}/s"
    store = Store.create(spark, path, SCHEMA)
    assert store.count() == 0 and store.read().collect() == [] and store.versions() == [0]
    assert store.add(rows_of(spark, [(f"a{k}", f"one {k}") for k in range(50)] + [(None, "no id")])) == 50
    batch = rows_of(spark, [(f"a{k}", "changed") for k in range(40, 60)] + [("a59", "a smaller text"), ("b", None)])
    bad = batch.withColumn("text", F.when(F.col("id") == "a55", F.raise_error(F.lit("no luck"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no luck"):
        store.add(bad)
    with pytest.raises(Exception, match="no luck"):  # in the tasks that write
        bad.write.format(stores.NAME).mode("append").save(path)
    assert store.versions() == [0, 1] and store.count() == 50 == store.read().count()
    time.sleep(1)  # tasks that were killed may still be writing
    left = data_names(path) - named(path)
    assert store.vacuum() == 0 and store.vacuum(0) == len(left)
    assert data_names(path) == named(path)
    assert store.add(batch) == 11
    want = [(f"a{k}", f"one {k}") for k in range(50)] + [(f"a{k}", "changed") for k in range(50, 59)] + [("a59", "a smaller text"), ("b", None)]
    again = Store.open(spark, path)
    assert content(again.read()) == content(rows_of(spark, want)) and again.count() == 61
    assert content(again.read(1)) == content(rows_of(spark, want[:50]))
    assert again.add(batch) == 0 and again.versions() == [0, 1, 2]
    assert content(spark.read.format(stores.NAME).load(path)) == content(again.read())
    assert spark.read.format(stores.NAME).option("version", 1).load(path).count() == 50


def test_many_new_ids_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "BROADCAST_IDS", 2)
    store = Store.create(spark, f"{tmp_path}/s", SCHEMA)
    store.add(rows_of(spark, [(str(k), "x") for k in range(10)]))
    assert store.add(rows_of(spark, [(str(k), "y") for k in range(5, 15)])) == 5
    assert {r.id: r.text for r in store.read().collect()} == {str(k): "x" if k < 10 else "y" for k in range(15)}


def test_a_writer_that_comes_second_looks_again(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    store = Store.create(spark, path, SCHEMA)
    real = Store.missing
    calls = []

    def late(self, rows, key, version):
        calls.append(version)
        found = real(self, rows, key, version)
        if len(calls) == 1:  # another writer publishes after the ids were looked at
            other = rows_of(spark, [("2", "other"), ("9", "other")])
            other.write.format(stores.NAME).mode("append").option("base", version).save(path)
        return found

    monkeypatch.setattr(Store, "missing", late)
    assert store.add(rows_of(spark, [("1", "mine"), ("2", "mine")])) == 1
    assert calls == [0, 1]
    assert content(store.read()) == content(rows_of(spark, [("1", "mine"), ("2", "other"), ("9", "other")]))
    assert data_names(path) == named(path)


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    store = Store.create(spark, f"{tmp_path}/s", SCHEMA)
    with ThreadPoolExecutor(3) as pool:
        added = list(pool.map(lambda w: store.add(rows_of(spark, [(f"{w}-{k}", "x") for k in range(5)] + [("shared", "x")])), range(3)))
    assert sum(added) == 16 == store.count() == store.read().select("id").distinct().count() == store.read().count()


def test_compaction_keeps_the_rows(spark, tmp_path):
    store = Store.create(spark, f"{tmp_path}/s", SCHEMA)
    for k in range(3):
        store.add(rows_of(spark, [(f"{k}-{i}", "x") for i in range(4)]))
    before, files = content(store.read()), len(stores.data_files(store.path, stores.snapshot(store.path)))
    version = store.compact()
    assert content(store.read()) == before and store.count() == 12 and version == 4
    assert len(stores.data_files(store.path, stores.snapshot(store.path))) == 1 < files
    assert content(store.read(3)) == before


def test_large_batches_make_several_files(spark, tmp_path, monkeypatch):
    written = []
    store = Store.create(spark, f"{tmp_path}/s", "id long, text string", "id")
    monkeypatch.setattr(stores, "FILE_BYTES", 1000)
    writer = stores.StoreWriter({"path": store.path}, store.read().schema, False)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"id": list(range(k, k + 10)), "text": ["t" * 100] * 10}) for k in range(0, 50, 10)]
    written.append(writer.write(iter(batches)))
    writer.commit([*written, None])
    assert len(written[0].files) == 5 and store.count() == 50 == store.read().count()


def test_what_does_not_fit_is_an_error(spark, tmp_path):
    store = Store.create(spark, f"{tmp_path}/s", SCHEMA)
    with pytest.raises(stores.StoreConflict):
        Store.create(spark, f"{tmp_path}/s", SCHEMA)
    with pytest.raises(FileNotFoundError):
        Store.open(spark, f"{tmp_path}/none")
    with pytest.raises(Exception, match="the store holds"):
        spark.createDataFrame([("a", 1)], "id string, text int").selectExpr("id", "text", "array(1.0f) as vector").write.format(stores.NAME).mode("append").save(store.path)
    with pytest.raises(ValueError, match="no column"):
        Store.create(spark, f"{tmp_path}/t", "a int", "id")
