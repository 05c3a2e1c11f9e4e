"""Unicode form NFKC, which Spark has no function for: one Arrow-batched pass over the rows that are not ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    return _nfkc(text)


def with_nfkc(rows: DataFrame, **texts: Column) -> DataFrame:
    """rows with the named texts in form NFKC. A CASE would not keep ASCII rows from the function, so they are a branch
    of their own."""
    foreign = F.coalesce(F.concat_ws("", *texts.values()).rlike(r"[^\x00-\x7F]"), F.lit(False))
    plain = rows.where(~foreign).select("*", *[t.alias(n) for n, t in texts.items()])
    return plain.union(rows.where(foreign).select("*", *[nfkc(t).alias(n) for n, t in texts.items()]))
