from tessera.operators.chunking import chunk_pages
from tessera.streaming.ingest import ingest


def test_a_stream_gives_the_chunks_of_the_batch_path(spark, tmp_path):
    schema = "source string, page long, text string"
    pages = spark.createDataFrame([(f"s{i}", p, f"Page {p} of {i}. It goes on. " * 30) for i in range(4) for p in range(3)], schema)
    pages.repartition(2).write.parquet(f"{tmp_path}/pages")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/pages")
    ingest(stream, f"{tmp_path}/chunks", f"{tmp_path}/checkpoint", 100, 20).awaitTermination()
    pick = lambda df: sorted(tuple(r) for r in df.select("id", "text", "page", "source", "index").collect())
    assert pick(spark.read.parquet(f"{tmp_path}/chunks")) == pick(chunk_pages(pages, 100, 20))
