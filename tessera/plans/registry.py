"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import queries as Q
from tessera.plans.oracles import ORACLES

#: Registered without SQL: Unicode folding, approximate search, learned vectors and fitted scores have no SQL form; see the tests.
WITHOUT_SQL = ("nfkc_text", "topk_graph", "graph_recall", "learned_vectors", "entailment_held_out", "aligned_verdicts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(Q, name) for name in (*ORACLES, *WITHOUT_SQL)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
