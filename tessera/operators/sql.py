"""Models from SQL text: table functions that take any table and add what a model says of its rows.

`register` makes three of them, each over `TABLE(...)`, with `PARTITION BY` where rows shall meet their model by key:

- `model_reply(TABLE(...), system => '...', json_mode => false)` adds reply, model and error, from the column `prompt`;
- `text_embedding(TABLE(...))` adds embedding, from the column `text`;
- `entailment(TABLE(...))` adds p, from the columns `premise` and `claim`.

All columns of the table stay. A table without the columns that are needed, or with one of the added names, is an error of the analysis.
Models are opened once a task, when its first row comes. Defined results: a null prompt is asked as an empty one, null texts count as empty, a failed call
is a row with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.config import DEFAULTS
from tessera.operators.embedding import Encoder
from tessera.operators.generation import ANSWER_TOKENS, STRICT_SYSTEM, Client, complete
from tessera.operators.verification import Predictor

REPLY = StructType().add("reply", StringType()).add("model", StringType()).add("error", StringType())
EMBEDDING = StructType().add("embedding", ArrayType(DoubleType()))
ENTAILED = StructType().add("p", DoubleType())


def with_added(table: AnalyzeArgument, needed: tuple[str, ...], added: StructType) -> AnalyzeResult:
    """The table's columns and the added ones."""
    if not table.isTable:
        raise ValueError("a table is needed: TABLE(...)")
    names = table.dataType.fieldNames()
    if missing := [c for c in needed if c not in names]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    if twice := [c for c in added.fieldNames() if c in names]:
        raise ValueError(f"the table has a column {', '.join(twice)} already")
    return AnalyzeResult(StructType([*table.dataType.fields, *added.fields]))


def reply_function(load: Callable[[], Client], models: tuple[str, ...], wait: Callable[[float], None] | None):
    class ModelReply:
        def __init__(self):
            self.client = None

        @staticmethod
        def analyze(rows: AnalyzeArgument, system: AnalyzeArgument | None = None, json_mode: AnalyzeArgument | None = None) -> AnalyzeResult:
            return with_added(rows, ("prompt",), REPLY)

        def eval(self, rows: Row, system: str | None = None, json_mode: bool | None = None) -> Iterator[tuple]:
            self.client = self.client or load()
            try:
                settings = {} if wait is None else {"wait": wait}
                found = (*complete(self.client, list(models), system or STRICT_SYSTEM, rows["prompt"] or "", bool(json_mode), ANSWER_TOKENS, **settings), None)
            except Exception as error:  # noqa: BLE001  a failed call is a row, not a failed job
                found = (None, None, f"{type(error).__name__}: {error}")
            yield (*rows, *found)

    return udtf(ModelReply)


def embedding_function(load: Callable[[], Encoder]):
    class TextEmbedding:
        def __init__(self):
            self.model = None

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            return with_added(rows, ("text",), EMBEDDING)

        def eval(self, rows: Row) -> Iterator[tuple]:
            self.model = self.model or load()
            vector = np.asarray(self.model([rows["text"] or ""]), np.float64)[0]
            length = float(np.linalg.norm(vector))
            yield (*rows, (vector / (length or 1.0)).tolist())

    return udtf(TextEmbedding)


def entailment_function(load: Callable[[], Predictor]):
    class Entailment:
        def __init__(self):
            self.model = None

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            return with_added(rows, ("premise", "claim"), ENTAILED)

        def eval(self, rows: Row) -> Iterator[tuple]:
            self.model = self.model or load()
            yield (*rows, float(self.model([(rows["premise"] or "", rows["claim"] or "")])[0]))

    return udtf(Entailment)


def register(
    spark: SparkSession, client: Callable[[], Client] | None = None, encoder: Callable[[], Encoder] | None = None, predictor: Callable[[], Predictor] | None = None,
    models: tuple[str, ...] = DEFAULTS.models, wait: Callable[[float], None] | None = None,
) -> None:
    """Register the functions for the loaders that are given; a function of the same name is replaced."""
    if client:
        spark.udtf.register("model_reply", reply_function(client, models, wait))
    if encoder:
        spark.udtf.register("text_embedding", embedding_function(encoder))
    if predictor:
        spark.udtf.register("entailment", entailment_function(predictor))
