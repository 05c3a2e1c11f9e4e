"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import deleted, split_join, stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
    return row.n, row.h


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is joined to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return split_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u (the larger end) and its smaller neighbours are joined to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = split_join(edges, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, folder: str, name: str, most_rounds: int = 60) -> DataFrame:
    """(v, label) for every end of an edge: label is the least end that it can reach.

    Edges are the first two columns, of any orderable type. A vertex with many neighbours is pre-aggregated to its
    least one and met again in joins that can be split, never gathered. Rounds grow with the logarithm of the size; each is written.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = stored(now, folder, f"{name}-0")
    mark = _mark(now)
    for k in range(1, most_rounds + 1):
        if not mark[0]:
            break
        now = stored(_small_star(_large_star(now)), folder, f"{name}-{k}")
        deleted(edges.sparkSession, folder, f"{name}-{k - 1}")
        if (after := _mark(now)) == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("v"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("v"), F.col("v").alias("label")).union(roots)
