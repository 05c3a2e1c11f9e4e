"""Scoring results against question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.nfkc import with_nfkc
from tessera.operators.decision import SHOWN
from tessera.tables import stored, work_dir

#: configuration, verifier (null: off), naive prompt
CONFIGS = (("none", None, False), ("llm", "llm", False), ("nli", "nli", False), ("naive", None, True), ("naive_llm", "llm", True))


def configured(questions: DataFrame) -> DataFrame:
    """Every question under each of the five configurations: one plan for all."""
    cases = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(v).cast("string").alias("verifier"), F.lit(n).alias("naive")) for c, v, n in CONFIGS])
    return questions.select("*", F.inline(cases))


def folded(results: DataFrame) -> DataFrame:
    """results with own and wanted, the answer and what it must hold, in Unicode form NFKC. They are written first, as folding reads
    its input twice."""
    results = stored(results, work_dir(results.sparkSession, "results"), "rows")
    rows = with_nfkc(results, own=F.col("answer"), joined=F.array_join("expect", "\x1f"))
    wanted = F.when(F.size("expect") > 0, F.split("joined", "\x1f")).otherwise(F.col("expect"))
    return rows.withColumn("wanted", wanted)


def eval_rows(results: DataFrame) -> DataFrame:
    """config, type, q, kind, status, answer, correct, hallucinated. results has type, expect, status, answer.

    Where the call to the model failed, nothing is known: both are null, and the rates leave the row out.
    """
    results = folded(results)
    shown = F.when(F.col("status") != "failed", F.col("status").isin(*SHOWN))
    answerable = F.col("type") == "answerable"
    return results.select(
        "config", "type", "q", "kind", "status", "answer",
        F.when(answerable, shown & F.coalesce(T.is_correct(F.col("own"), F.col("wanted")), F.lit(False))).alias("correct"),
        F.when(~answerable, shown).alias("hallucinated"),
    )


def eval_summary(rows: DataFrame) -> DataFrame:
    """Rates by configuration; null where there is nothing to count. The last column also counts unanswerable
    questions whose answers were called grounded."""
    ans, una, grounded = F.col("type") == "answerable", F.col("type") == "unanswerable", F.col("status") == "grounded"
    answered = F.col("status") != "failed"
    rate = lambda k, n: F.try_divide(F.count_if(k).cast("double"), F.count_if(n).cast("double"))
    return rows.groupBy("config").agg(
        rate(ans & F.col("correct"), ans & answered).alias("answer_rate"),
        rate(una & ~F.col("hallucinated"), una & answered).alias("abstain_rate"),
        rate(una & F.col("hallucinated"), una & answered).alias("hallucination_rate"),
        rate(ans & grounded & F.col("correct"), ans & grounded).alias("grounded_precision"),
        F.count_if(ans).alias("n_answerable"),
        F.count_if(una).alias("n_unanswerable"),
        rate(ans & grounded & F.col("correct"), grounded).alias("grounded_precision_all"),
    )


def status_pivot(rows: DataFrame) -> DataFrame:
    """Questions by configuration (rows) and status (columns)."""
    return rows.groupBy("config").pivot("status", ["grounded", "partial", "ungrounded", "not_found", "unverified", "unchecked"]).count().na.fill(0)
