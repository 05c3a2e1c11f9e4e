"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Tokens are counted by cell (source, language, topic). Raking multiplies a cell's factor by target share over present
share, one dimension after the other, until all marginals agree; a cell's probability is its factor over the largest
one, so that no probability exceeds 1 and the expected tokens of the sample have exactly the raked marginals (less,
if `tokens` asks for fewer). A document is drawn by a hash of its id, so the same documents are drawn wherever and
however often the job runs.

Cells are few (sources * languages * topics): up to `DRIVER_CELLS` of them are raked on the driver; beyond that the same
steps run as joins, with targets as tables, and nothing but totals reaches the driver.

Defined results: null categories are one category of their own, `(none)`; null and empty texts have 0 tokens and take
their cell's probability; a target for an absent category is left out and the others keep their proportions; rows
that repeat an id are drawn or left together, rows without id by their text; if a marginal cannot be met (no tokens),
the rest is raked all the same; other columns, of any name, are kept by `sampled`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import split_join, stored, work_dir

DIMENSIONS = ("source", "lang", "topic")
#: Targets where none are given: observed shares to this power, so that small categories gain.
POWER = 0.85
ROUNDS = 200
TOLERANCE = 1e-8
DRIVER_CELLS = 200_000
NONE = "(none)"
SEED = 20_240_601


def topic_of(text: Column) -> Column:
    """A topic from plain signs in the text; a column of that name can take its place."""
    return (
        F.when(text.contains("License") | text.contains("Copyright"), "legal")
        .when(text.contains(" | "), "tables")
        .when(text.contains("%%%") | text.contains("***") | text.contains("$$$"), "symbols")
        .when(text.contains("@"), "contacts")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def with_cells(docs: DataFrame) -> DataFrame:
    """The columns of docs as c0, c1 and so on, then doc_id, text, mix_source, mix_lang, mix_topic and mix_tokens."""
    names = [c.lower() for c in docs.columns]
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    of = lambda name: F.col(f"c{names.index(name)}")
    text = of("text").cast("string")
    topic = of("topic").cast("string") if "topic" in names else topic_of(F.coalesce(text, F.lit("")))
    name = lambda c: F.coalesce(c, F.lit(NONE))
    return rows.select(
        "*", of("doc_id").cast("long").alias("doc_id"), text.alias("text"), name(of("source").cast("string")).alias("mix_source"),
        name(of("lang").cast("string")).alias("mix_lang"), name(topic).alias("mix_topic"), tokens_of(text).alias("mix_tokens"),
    )


def targets_of(marginals: dict[str, dict[str, float]], targets: dict[str, dict[str, float]] | None) -> dict[str, dict[str, float]]:
    """Shares by dimension and category, over the categories that have tokens."""
    out = {}
    for dimension, seen in marginals.items():
        given = (targets or {}).get(dimension)
        raw = {c: (given.get(c, 0.0) if given else n**POWER) for c, n in seen.items() if n > 0}
        total = sum(raw.values())
        if total:
            out[dimension] = {c: x / total for c, x in raw.items()}
    return out


def rake(cells: list[tuple[str, str, str, float]], targets: dict[str, dict[str, float]]) -> list[float]:
    """Factors of cells (source, language, topic, tokens)."""
    factors = [1.0] * len(cells)
    total = sum(c[3] for c in cells)
    for _ in range(ROUNDS):
        worst = 0.0
        for at, dimension in enumerate(DIMENSIONS):
            if dimension not in targets:
                continue
            sums: dict[str, float] = {}
            for c, f in zip(cells, factors, strict=True):
                sums[c[at]] = sums.get(c[at], 0.0) + c[3] * f
            scale = {c: targets[dimension].get(c, 0.0) * total / s for c, s in sums.items() if s > 0}
            worst = max([worst, *(abs(s - 1) for s in scale.values())])
            factors = [f * scale.get(c[at], 1.0) for c, f in zip(cells, factors, strict=True)]
        if worst < TOLERANCE:
            break
    return factors


def goals_joined(cells: DataFrame, targets: dict[str, dict[str, float]] | None) -> dict[str, DataFrame]:
    """What `targets_of` gives, as a table (dimension, goal in tokens) of each dimension that has tokens."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens").cast("double").alias("n")).first().n or 0.0
    out = {}
    for dimension in DIMENSIONS:
        seen = cells.groupBy(dimension).agg(F.sum("tokens").alias("have")).where("have > 0")
        given = (targets or {}).get(dimension)
        if given:
            asked = spark.createDataFrame([(c, float(x)) for c, x in given.items()], f"{dimension} string, raw double")
            seen = seen.join(asked, dimension, "left").select(dimension, F.coalesce("raw", F.lit(0.0)).alias("raw"))
        else:
            seen = seen.select(dimension, F.pow("have", F.lit(POWER)).alias("raw"))
        if raw := seen.agg(F.sum("raw").alias("n")).first().n:
            out[dimension] = seen.select(dimension, (F.col("raw") * F.lit(total / raw)).alias("goal"))
    return out


def rake_joined(cells: DataFrame, goals: dict[str, DataFrame], folder: str) -> DataFrame:
    """The same as `rake`, as joins over a table of cells (source, lang, topic, tokens); adds factor."""
    goals = {d: stored(g, folder, f"goals-{d}") for d, g in goals.items()}
    now = cells.withColumn("factor", F.lit(1.0))
    for k in range(ROUNDS):
        now = now.withColumn("before", F.col("factor"))
        for dimension, goal in goals.items():
            sums = now.groupBy(dimension).agg(F.sum(F.col("tokens") * F.col("factor")).alias("have")).join(goal, dimension, "left")
            sums = sums.select(dimension, F.when(F.col("have") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("have")).otherwise(1.0).alias("scale"))
            now = split_join(now, sums, [dimension]).withColumn("factor", F.col("factor") * F.col("scale")).drop("scale")
        now = stored(now.select("source", "lang", "topic", "tokens", "factor", "before"), folder, f"raked-{k}")
        change = now.agg(F.max(F.abs(F.col("factor") / F.greatest("before", F.lit(1e-300)) - 1)).alias("x")).first().x
        if change is None or change < TOLERANCE:
            break
    return now.drop("before")


def probabilities(docs: DataFrame, targets=None, tokens: float | None = None, folder: str | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """source, lang, topic, factor, prob of every cell of docs (which carry the columns of with_cells)."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "mixing")
    cells = docs.groupBy(F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"))
    cells = stored(cells.agg(F.sum("mix_tokens").cast("double").alias("tokens")), folder, "cells")
    if cells.limit(driver_cells + 1).count() <= driver_cells:
        rows = sorted(tuple(r) for r in cells.select("source", "lang", "topic", "tokens").collect())
        sums: dict[str, dict[str, float]] = {d: {} for d in DIMENSIONS}
        for r in rows:
            for d, c in zip(DIMENSIONS, r, strict=False):
                sums[d][c] = sums[d].get(c, 0.0) + r[3]
        factors = rake(rows, targets_of(sums, targets))
        raked = spark.createDataFrame([(*r, f) for r, f in zip(rows, factors, strict=True)], "source string, lang string, topic string, tokens double, factor double")
    else:
        raked = rake_joined(cells, goals_joined(cells, targets), folder)
    most = raked.where("tokens > 0").agg(F.max("factor").alias("f"), F.sum(F.col("tokens") * F.col("factor")).alias("n")).first()
    unit = 1 / most.f if most.f else 1.0
    if tokens is not None and most.n:
        unit = min(unit, tokens / most.n)
    return raked.select("source", "lang", "topic", "factor", F.least(F.lit(1.0), F.col("factor") * F.lit(unit)).alias("prob"))


def drawn(prob: Column) -> Column:
    by_text = F.when(F.col("doc_id").isNull(), F.col("text").cast("string"))
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), by_text, F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52)) < prob


def with_probabilities(docs: DataFrame, **settings) -> DataFrame:
    rows = with_cells(docs)
    cells = probabilities(rows, **settings).select(
        F.col("source").alias("mix_source"), F.col("lang").alias("mix_lang"), F.col("topic").alias("mix_topic"), F.col("factor").alias("mix_factor"),
        F.col("prob").alias("mix_prob"),
    )
    few = cells.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS
    return rows.join(F.broadcast(cells) if few else cells, ["mix_source", "mix_lang", "mix_topic"])


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight (the raked factor), prob and sampled for every document."""
    rows = with_probabilities(docs, **settings)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("n_tokens"), F.col("mix_factor").alias("weight"), F.col("mix_prob").alias("prob"), drawn(F.col("mix_prob")).alias("sampled"),
    )


def sampled(docs: DataFrame, **settings) -> DataFrame:
    """The drawn rows of docs, with their own columns."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    return with_probabilities(docs, **settings).where(drawn(F.col("mix_prob"))).select(*own).toDF(*docs.columns)
