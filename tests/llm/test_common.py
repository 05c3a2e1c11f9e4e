import pytest
from pyspark.sql import functions as F

from tessera.llm import common

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def small_partitions(spark):
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield
    for name in SETTINGS:
        spark.conf.unset(name)


def test_a_hot_key_is_split_in_a_join_with_an_aggregate(spark, small_partitions):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(12)
    sums = rows.groupBy("k").agg(F.count("*").alias("n"))
    plain, split = rows.join(sums, "k"), common.split_join(rows, sums, ["k"])
    for how in ("inner", "left"):
        assert common.split_join(rows, sums, ["k"], how).columns == ["k", "x", "n"]
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.collect()))
    assert "skew=true" in split._jdf.queryExecution().executedPlan().toString()


def test_deleted_tables_are_gone(spark, tmp_path):
    folder = f"file://{tmp_path}"
    common.stored(spark.range(3), folder, "a")
    common.stored(spark.range(3), folder, "b")
    common.deleted(spark, folder, "a", "never")
    common.freed(spark)
    assert not (tmp_path / "a").exists() and (tmp_path / "b").exists()


def test_ids_are_kept_or_dropped_on_both_sides_of_the_bound(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    ids = spark.createDataFrame([(2,), (9,)], "doc_id long")
    for bound in (2, 1):
        assert sorted(r.text for r in common.keep_ids(docs, ids, "left_anti", bound).collect()) == ["a", "d"]
        assert sorted(r.text for r in common.keep_ids(docs, ids, "left_semi", bound).collect()) == ["b", "c"]
