"""A small document of five pages, for trying things out where no file is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import files, pdf

NAME = "harbour.pdf"
PAGES = (
    "1. Lamps\n\nEach buoy carries one oil lamp. It is lit at dusk and put out at dawn. A lamp holds 25 litres of oil.",
    "2. Oars\n\nA boat has six oars and two spares. Crews row up to 12 miles per watch. A broken oar is replaced within two days.",
    "3. Watches\n\nA watch lasts four hours. The third watch begins at midnight. Nobody stands two watches in a row.",
    "4. Fees\n\nShips under thirty metres pay 14 crowns a night. Larger ships pay 40 crowns. Fees are due before leaving.",
    "5. Storms\n\nAt wind force nine the harbour closes. The bell rings five times. Small boats are pulled ashore.",
)


def sample_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(NAME, n, text) for n, text in enumerate(PAGES, start=1)], files.PAGES)


def write_sample(spark: SparkSession, path: str) -> None:
    """The sample as a PDF file below a folder: a title, text and a footer on each page."""
    rows = [(NAME, n, *text.split("\n\n", 1)[::-1], f"Harbour rules, page {n}") for n, text in enumerate(PAGES, start=1)]
    pdf.write_pdf(spark.createDataFrame(rows, "source string, page long, text string, title string, footer string").coalesce(1), path)


def pages_or_sample(spark: SparkSession, path: str | None = None, **options) -> DataFrame:
    """The pages of the files that a path or glob names, or of the sample where none is named."""
    return files.pdf_pages(spark, path, **options) if path else sample_pages(spark)
