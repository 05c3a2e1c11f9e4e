import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking
from tessera.streaming import registry

SCHEMA = "source string, page long, text string, expected long, arrived timestamp"
START = datetime.datetime(2020, 1, 1)


def page(source, number, text, expected=None, minute=0):
    return (source, number, text, expected, START + datetime.timedelta(minutes=minute))


def sent(spark, path, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{name}")


def run(spark, path, schema=SCHEMA, **settings):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    registry.start(stream, f"{path}/out", 100, 20, **settings)
    return {r.source: r for r in registry.registered(spark, f"{path}/out").collect()}


def batch(spark, rows):
    pages = spark.createDataFrame(rows, SCHEMA).select("source", "page", F.coalesce("text", F.lit("")).alias("text"))
    chunks = chunking.chunk_pages(pages, 100, 20)
    return {tuple(r) for r in chunks.select("id", "text", "page", "source", "index").collect()}


def chunks_of(spark, path):
    return {tuple(r) for r in registry.indexed(spark, f"{path}/out").select("id", "text", "page", "source", "index").collect()}


def text(rng):
    return " ".join(f"Word {rng.random()} goes on." for _ in range(rng.randint(1, 40)))


def test_pieces_restarts_repeats_and_changes(spark, tmp_path):
    rng = random.Random(1)
    rows = [page(f"s{i}", n, text(rng), 8) for i in range(3) for n in range(8)] + [page("late", n, text(rng), 3) for n in range(2)]
    rng.shuffle(rows)
    sent(spark, tmp_path, rows[:9], "a")
    sent(spark, tmp_path, rows[9:14] + rows[:3], "b")  # some pages again
    first = run(spark, tmp_path)
    assert all(r.n_pages == 8 for r in first.values())
    sent(spark, tmp_path, rows[14:], "c")
    found = run(spark, tmp_path)  # goes on from the checkpoints
    whole = [r for r in rows if r[0] != "late"]
    want = batch(spark, whole)
    assert {s: (r.n_pages, r.n_chunks, r.revision, r.why) for s, r in found.items()} == {f"s{i}": (8, sum(c[3] == f"s{i}" for c in want), 1, "whole") for i in range(3)}
    assert {c[0].split(":")[0] for c in want} == {r.doc_key for r in found.values()}
    assert chunks_of(spark, tmp_path) == want
    # The same again is no news; a changed page and a last page are.
    changed = page("s1", 3, "Another text.", 8, minute=5)
    sent(spark, tmp_path, [r for r in rows if r[0] in ("s0", "s1")] + [changed, page("s1", 3, "An older text.", 8, minute=4), page("late", 2, None, 3)], "d")
    found = run(spark, tmp_path)
    assert {s: r.revision for s, r in found.items()} == {"s0": 1, "s1": 2, "s2": 1, "late": 1}
    now = [r for r in rows if (r[0], r[1]) != ("s1", 3)] + [changed, page("late", 2, None, 3)]
    assert chunks_of(spark, tmp_path) == batch(spark, now)


def test_a_timer_announces_sources_of_unknown_size(spark, tmp_path):
    rows = [page("x", n, f"Page {n}. It ends.") for n in range(3)] + [page(None, 1, "No name.")]
    sent(spark, tmp_path, rows, "a")
    assert set(run(spark, tmp_path, quiet=0.0)) <= {"x", None}  # a timer fires in a later batch
    sent(spark, tmp_path, [page("y", 1, "Another.")], "b")
    found = run(spark, tmp_path, quiet=0.0)
    assert found["x"].n_pages == 3 and found["x"].why == "quiet" and found["x"].revision == 1 and found[None].n_pages == 1
    assert {c for c in chunks_of(spark, tmp_path) if c[3] != "y"} == batch(spark, rows)


def test_a_source_that_is_not_whole_is_held_back(spark, tmp_path):
    sent(spark, tmp_path, [page("x", 1, "One."), page("w", 1, "One.", 1)], "a")
    found = run(spark, tmp_path, quiet=3600.0)
    assert set(found) == {"w"} and {c[3] for c in chunks_of(spark, tmp_path)} == {"w"}


def test_pages_without_the_further_columns(spark, tmp_path):
    schema = "source string, page long, text string"
    spark.createDataFrame([("a", 1, "One."), ("a", 2, None)], schema).write.parquet(f"{tmp_path}/in")
    assert run(spark, tmp_path, schema, quiet=3600.0) == {}
    assert registry.indexed(spark, f"{tmp_path}/out").collect() == []
    assert spark.read.schema(registry.DELTAS).parquet(f"{tmp_path}/out/deltas").agg(F.sum("pages")).first()[0] == 2


@pytest.mark.parametrize("buckets", [1, 3])
def test_buckets_do_not_matter(spark, tmp_path, buckets):
    rng = random.Random(buckets)
    rows = [page(f"s{k % 2}", k, text(rng), 10) for k in range(20)]
    packed = chunking.packed_pages(spark.createDataFrame(rows, SCHEMA), 100, 20)
    packed.select(*[c.split()[0] for c in registry.PAGES.split(", ")]).write.parquet(f"{tmp_path}/pages")
    spark.conf.set(registry.PROVIDER, registry.ROCKS)
    stream = registry.ledger(spark.readStream.schema(registry.PAGES).parquet(f"{tmp_path}/pages"), buckets)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/deltas").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/deltas").groupBy("source").agg(F.sum("pages").alias("p"), F.sum("chunks").alias("c")).collect()
    assert {r.source: r.p for r in got} == {"s0": 10, "s1": 10} and sum(r.c for r in got) == packed.agg(F.sum("n")).first()[0]
