"""PDF files as a data source: `spark.read.format("tessera_pdf")` gives pages, `df.write.format("tessera_pdf")` writes them.

Reading: files are listed with their sizes; small ones are packed to partitions of about `rangeBytes`, and a larger one is cut
to ranges of its pages, each a task that reads the file's cross references and the objects of its own pages. The driver reads no file.

Writing: each task writes the rows it has, in their order, a file for each run of rows of one source, of at most `filePages`
pages. A commit writes a list of what was written, and readers take what such lists name, so that files of lost or repeated tasks do not count.
`write_pdf` deals rows out by source and page, so a source of any size is many tasks and files.

Defined results: null text is an empty page; pages without text are read with no block. A file that is not a PDF, or encrypted, is an
error, or left out with mode DROPMALFORMED. Labels are only known of files written here.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.files import created, files_below, open_fs, removed
from tessera.sources.pdf_format import BadPdf, PdfFile
from tessera.sources.pdf_text import pages
from tessera.sources.pdf_write import PdfWriter

NAME = "tessera_pdf"
SCHEMA = "source string, page long, label string, blocks array<string>"
ARROW = pa.schema([("source", pa.string()), ("page", pa.int64()), ("label", pa.string()), ("blocks", pa.list_(pa.string()))])
RANGE_BYTES = 8 << 20
FILE_PAGES = 10_000
#: Pages of an Arrow batch, and their characters at most.
BATCH_PAGES, BATCH_CHARACTERS = 256, 4 << 20
LIST = "_committed-"


@dataclass
class Share(InputPartition):
    """Parts of files: (path, size, which part, of how many)."""

    parts: list[tuple[str, int, int, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PdfFileWriter(self.options, overwrite)


class PdfReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]
        self.range = int(options.get("rangeBytes", RANGE_BYTES))
        self.drop = options.get("mode", "FAILFAST").upper() == "DROPMALFORMED"

    def partitions(self) -> list[Share]:
        shares: list[Share] = []
        held, size = [], 0
        for path, n in committed(self.uri):
            cut = -(-n // self.range)
            if cut > 1:
                shares += [Share([(path, n, k, cut)]) for k in range(cut)]
                continue
            if held and size + n > self.range:
                shares.append(Share(held))
                held, size = [], 0
            held.append((path, n, 0, 1))
            size += n
        return shares + [Share(held)] * bool(held)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.uri)
        rows: list[dict] = []
        size = 0
        for path, n, part, of in partition.parts:
            try:
                with fs.open_input_file(path) as file:
                    pdf = PdfFile(file, n)
                    count = pdf.count()
                    for number, label, texts in pages(pdf, count * part // of, count * (part + 1) // of):
                        rows.append({"source": path.rsplit("/", 1)[-1], "page": number, "label": label, "blocks": texts})
                        size += sum(map(len, texts))
                        if len(rows) >= BATCH_PAGES or size >= BATCH_CHARACTERS:
                            yield pa.RecordBatch.from_pylist(rows, ARROW)
                            rows, size = [], 0
            except BadPdf as e:
                if not self.drop:
                    raise BadPdf(f"{path}: {e}") from e
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


def committed(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of the PDF files below a folder; where there are lists of what was committed, of those alone."""
    found = files_below(uri, ".pdf")
    fs, top = open_fs(uri)
    lists = [p for p, _ in files_below(uri, ".json") if p.rsplit("/", 1)[-1].startswith(LIST)] if not re.search("[*?]", uri) and fs.get_file_info(top).type.name == "Directory" else []
    if not lists:
        return found
    named: set[str] = set()
    for path in lists:
        with fs.open_input_file(path) as f:
            named |= {f"{path.rsplit('/', 1)[0]}/{name}" for name in json.loads(f.read())}
    return [(p, n) for p, n in found if p in named]


class PdfFileWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.uri = options["path"].rstrip("/")
        self.pages = int(options.get("filePages", FILE_PAGES))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = open_fs(self.uri)
        fs.create_dir(top, recursive=True)
        attempt = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        files: list[str] = []
        source, out, writer = None, None, None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if writer is None or row["source"] != source or writer.pages >= self.pages or writer.full:
                        if writer:
                            writer.close()
                            out.close()
                        source = row["source"]
                        files.append(f"{re.sub(r'[^A-Za-z0-9._-]', '_', source or 'unnamed')}-{attempt}-{len(files)}.pdf")
                        out = fs.open_output_stream(f"{top}/{files[-1]}")
                        writer = PdfWriter(out)
                    label = row.get("label")
                    writer.page(row["text"] or "", str(label if label is not None else row["page"]), row.get("title"), row.get("footer"))
            if writer:
                writer.close()
                out.close()
        except BaseException:
            with suppress(Exception):
                out.close()
            removed(self.uri, files)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            removed(self.uri, [name for path, _ in files_below(self.uri, ".json") if (name := path.rsplit("/", 1)[-1]).startswith(LIST)])
        created(f"{self.uri}/{LIST}{uuid.uuid4().hex}.json", json.dumps([name for m in messages if m for name in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        removed(self.uri, [name for m in messages if m for name in m.files])


def read_pdf(spark: SparkSession, path: str, **options) -> DataFrame:
    """source, page, label, blocks of the PDF files that a file's path, a folder or a pattern names."""
    spark.dataSource.register(PdfSource)
    return spark.read.format(NAME).options(**options).load(path)


def write_pdf(rows: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Write pages as PDF files. rows: source, page, text, and label, title, footer if there are such."""
    rows.sparkSession.dataSource.register(PdfSource)
    own = [F.col(c).cast("string").alias(c) for c in ("label", "title", "footer") if c in rows.columns]
    dealt = rows.select("source", F.col("page").cast("long").alias("page"), F.col("text").cast("string").alias("text"), *own)
    dealt = dealt.repartitionByRange("source", "page").sortWithinPartitions("source", "page")
    dealt.write.format(NAME).mode(mode).options(**options).save(path)
