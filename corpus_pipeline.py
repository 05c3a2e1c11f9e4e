"""Documents to token files: language ID, near duplicates, decontamination, mixing, token output.

Every stage reads all rows that its predecessor kept, from a written table, and returns the columns of documents; the
last returns what its token files hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, language_id, mixing, ngram_join, token_files
from tessera.llm.queries import END_ID, tokenizer_path
from tessera.shipping import ship

FOLDS, FOLD = 4, 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter in any language (`und`) go."""
    ship(spark)
    names = docs.columns
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    samples = language_id.training_sample(labelled.where(~common.held_out(F.col("doc_id"), FOLDS, FOLD)))
    plain = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(names)])
    found = language_id.predict_language(plain, samples, tuple(plain.columns))
    return found.where("lang_pred <> 'und'").drop("lang_pred", "score").toDF(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links reach, the document with the least doc_id stays; rows without id stay.

    Where rows share a doc_id, each is judged by its own text: a row goes only if its group keeps another one.
    """
    ship(spark)
    names = docs.columns
    folder = common.work_dir(spark, "near-duplicates")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return drop_rows(docs, folder).toDF(*names)
    found = common.stored(ngram_join.near_duplicates(docs), folder, "components")
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    return common.keep_ids(docs, dropped, "left_anti").select(*names)


def drop_rows(docs: DataFrame, folder: str) -> DataFrame:
    """The same where ids are repeated: a written table has a number for each row, which stands in for the doc_id."""
    own = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    rows = common.stored(docs.toDF(*own).withColumn("doc_id", F.monotonically_increasing_id()), folder, "rows")
    found = common.stored(ngram_join.near_duplicates(rows), folder, "components")
    named = rows.select("doc_id", F.col(own[docs.columns.index("doc_id")]).cast("long").alias("id"), F.sha2("text", 256).alias("digest"))
    none = F.col("n_shingles") == 0  # a text without a word is in no group but that of its repetitions
    group = [F.when(~none, F.col("component_id")).alias("a"), F.when(none, F.col("id")).alias("b"), F.when(none, F.col("digest")).alias("c")]
    judged = named.where("id is not null").join(found, "doc_id").select("id", "doc_id", *group)
    stay = judged.groupBy("a", "b", "c").agg(F.min(F.struct("id", "doc_id")).alias("first")).select(F.col("first.doc_id").alias("doc_id"))
    dropped = common.stored(judged.select("doc_id").join(stay, "doc_id", "left_anti"), folder, "dropped")
    return common.keep_ids(rows, dropped, "left_anti").select(*own)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    ship(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens have the target shares of sources, languages and topics."""
    ship(spark)
    return mixing.sampled(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_files.token_files(docs, tokenizer_path(), END_ID)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID output", tokenized),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = common.stored(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
