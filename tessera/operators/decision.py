"""From gate, draft and verdicts to a status and the answer that is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# The messages are fixed values.
NOT_FOUND_MESSAGE = "Not found in the document."
UNGROUNDED_MESSAGE = (
    "I could not verify an answer against the document, so I am not showing one. The unverified draft is available below."
)
#: Shown where the model could not be asked; that is no statement about the document.
FAILED_MESSAGE = "No answer: the call to the model failed."
SHOWN = ("grounded", "partial", "unchecked", "unverified")


def status() -> Column:
    """Over passed, error (of the generator's call), draft, verified (the verifier is on), verify_error, k, n."""
    return (
        F.when(~F.coalesce("passed", F.lit(False)), "not_found")
        .when(F.col("error").isNotNull(), "failed")
        .when(T.is_not_found(F.coalesce("draft", F.lit(""))), "not_found")
        .when(~F.col("verified"), "unchecked")
        .when(F.col("verify_error").isNotNull() | (F.coalesce("n", F.lit(0)) == 0), "unverified")
        .when(F.col("k") == F.col("n"), "grounded")
        .when(F.col("k") == 0, "ungrounded")
        .otherwise("partial")
    )


def shown_answer() -> Column:
    messages = {"not_found": NOT_FOUND_MESSAGE, "ungrounded": UNGROUNDED_MESSAGE, "failed": FAILED_MESSAGE}
    return F.coalesce(*[F.when(F.col("status") == name, message) for name, message in messages.items()], F.col("draft"))


def decided(rows: DataFrame) -> DataFrame:
    """rows with status, answer and abstained added. A failed call, where rows tell of one, is neither an answer nor an abstention."""
    rows = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
    out = rows.withColumn("status", status())
    return out.withColumn("answer", shown_answer()).withColumn("abstained", F.col("status").isin("not_found", "ungrounded"))
