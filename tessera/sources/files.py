"""Sources: PDF files, question sets, page tables; sinks: chunk tables, results as JSON and Markdown."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.files import open_fs
from tessera.functions import text as T
from tessera.sources import pdf

PAGES = "source string, page long, text string"
QUESTION_SET = (
    "document string, note string, answerable array<struct<q:string,expect:array<string>>>, "
    "unanswerable array<struct<q:string,kind:string>>"
)


def pages_of_documents(documents: DataFrame) -> DataFrame:
    """A `documents` table as pages: a source is a file and doc_id the page number."""
    return documents.select("source", F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def pages_of_blocks(blocks: DataFrame) -> DataFrame:
    """source, page, blocks array<string> (in reading order) to pages; empty pages go, their numbers stay unused."""
    text = T.join_blocks(F.transform("blocks", T.clean_block))
    return blocks.select("source", "page", text.alias("text")).where("text <> ''")


def pdf_pages(spark: SparkSession, path: str, reader: str = "own", **options) -> DataFrame:
    """Pages of all PDF files that a path, folder or pattern names, by the package's own reader (see `pdf`), or with
    reader='fitz' by PyMuPDF, which the executors need then; it reads a file whole."""
    blocks = pdf.read_pdf(spark, path, **options) if reader == "own" else fitz_blocks(spark, path)
    return pages_of_blocks(blocks)


def fitz_blocks(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source"), "content")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for batch in batches:
            rows = []
            for source, content in zip(batch["source"], batch["content"], strict=True):
                with fitz.open(stream=content, filetype="pdf") as opened:
                    for number, page in enumerate(opened, start=1):
                        texts = [b[4] for b in page.get_text("blocks", sort=True) if b[6] == 0]
                        rows.append((source, number, texts))
            yield pd.DataFrame(rows, columns=["source", "page", "blocks"])

    return files.mapInPandas(blocks, "source string, page long, blocks array<string>")


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """One row a question: type, q, expect, kind; the answerable ones first in their file."""
    spec = spark.read.schema(QUESTION_SET).json(path, multiLine=True)
    return explode_questions(spec)


def explode_questions(spec: DataFrame) -> DataFrame:
    answerable = spec.select("document", F.lit("answerable").alias("type"), F.posexplode("answerable").alias("no", "x"))
    unanswerable = spec.select("document", F.lit("unanswerable").alias("type"), F.posexplode("unanswerable").alias("no", "x"))
    return answerable.select("document", "type", "no", F.col("x.q").alias("q"), F.col("x.expect").alias("expect")).unionByName(
        unanswerable.select("document", "type", "no", F.col("x.q").alias("q"), F.col("x.kind").alias("kind")), allowMissingColumns=True
    )


def write_chunks(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    chunks.write.mode(mode).parquet(path)


def open_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Rows of detail that one document holds at most; larger results are two tables, see `write_results`.
DOCUMENT_ROWS = 100_000


def write_results(summary: DataFrame, detail: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(f"{path}/summary")
    detail.write.mode("overwrite").json(f"{path}/detail")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(summary, detail) as `write_results` wrote them."""
    return spark.read.json(f"{path}/summary"), spark.read.json(f"{path}/detail")


def write_results_document(summary: DataFrame, detail: DataFrame, path: str) -> None:
    """One JSON document for people and scripts: `summary`, a list with an object a configuration, and `detail`, lists by configuration.

    A document of more than DOCUMENT_ROWS rows is an error.
    """
    rows = [json.loads(r.line) for r in detail.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).limit(DOCUMENT_ROWS + 1).collect()]
    if len(rows) > DOCUMENT_ROWS:
        raise ValueError(f"more than {DOCUMENT_ROWS} rows: write_results writes tables")
    heads = [json.loads(r.line) for r in summary.orderBy("config").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).collect()]
    by_config: dict[str, list] = {head["config"]: [] for head in heads}
    for row in rows:
        by_config.setdefault(row.pop("config"), []).append(row)
    fs, target = open_fs(path)
    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(target) as out:
        out.write(json.dumps({"summary": heads, "detail": by_config}, indent=2, ensure_ascii=False).encode())


SUMMARY = (
    "config string, answer_rate double, abstain_rate double, hallucination_rate double, grounded_precision double, n_answerable long, n_unanswerable long, "
    "grounded_precision_all double, seconds double"
)


def read_summaries(spark: SparkSession, documents: dict[str, str]) -> DataFrame:
    """The summaries of several result documents, with the column `set`, the name that each is given."""
    read = lambda path: spark.read.schema(f"summary array<struct<{SUMMARY.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
    return reduce(DataFrame.unionByName, [read(path).select(F.lit(name).alias("set"), F.inline("summary")) for name, path in documents.items()])


def result_of(summaries: DataFrame, config: str, set_: str) -> DataFrame:
    """The summary of a configuration over a question set."""
    return summaries.where((F.col("config") == config) & (F.col("set") == set_))


def compared(summaries: DataFrame, value: str, sets: list[str] | None = None) -> DataFrame:
    """A value by configuration (rows) and question set (columns)."""
    return summaries.groupBy("config").pivot("set", sets).agg(F.first(value))


def with_seconds(summary: DataFrame, seconds: dict[str, float]) -> DataFrame:
    """The summary with the seconds that each configuration took, as `asking.run_configurations` tells them."""
    known = F.create_map(*[F.lit(x) for pair in seconds.items() for x in pair]) if seconds else F.lit(None).cast("map<string,double>")
    return summary.withColumn("seconds", F.round(F.try_element_at(known, F.col("config")), 1))


HEAD = ("Config", "Answer rate", "Abstain rate", "Hallucination rate", "Grounded precision")
#: What reports call the configurations.
LABELS = {
    "none": "Baseline RAG (no check)", "llm": "LLM verifier", "nli": "NLI verifier", "naive": "Naive prompt, no check", "naive_llm": "Naive prompt + LLM verifier",
}


def markdown_table(summary: DataFrame, labels: dict[str, str] | None = None) -> str:
    """The whole table with its head; a summary has one row a configuration. With seconds in the summary, there is a column for them."""
    lines = [r.line for r in markdown_lines(summary, labels).orderBy("config").collect()]
    head = (*HEAD, "Time (s)") if "seconds" in summary.columns else HEAD
    return "\n".join([f"| {' | '.join(head)} |", "|---" * len(head) + "|", *lines])


def markdown_lines(summary: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """The summary's rows as lines of a Markdown table (without head); configurations by their labels where these are given."""
    percent = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.0f%%", F.bround(F.col(c) * 100, 0)))
    name = F.coalesce(*[F.when(F.col("config") == k, v) for k, v in (labels or {}).items()], F.col("config"))
    cells = [name, percent("answer_rate"), percent("abstain_rate"), percent("hallucination_rate"), percent("grounded_precision")]
    if "seconds" in summary.columns:
        cells.append(F.when(F.col("seconds").isNull(), "n/a").otherwise(F.format_string("%.1f", "seconds")))
    return summary.select("config", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
