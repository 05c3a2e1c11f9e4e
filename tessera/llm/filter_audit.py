"""Filter interaction audit: what five document filters remove in every order of them, by a relational word pipeline.

Texts are dealt out by row. Words are exploded and aggregated by (row, word), then by row, for totals and distinct words; the
dealing holds for both, so neither shuffles again. The other flags come to the totals by outer joins: signs and capitals from the
row itself, copies from the least doc_id of each text's digest, labels from their own table. A row's five failures are one of 32
sets; per part 32 conditional counts (of all rows, of good and of toxic ones) are all that the 120 orders need, so documents are
aggregated once and the 600 steps are sums over 32 numbers.

Defined results: null text is empty, null lang is the part ''; a null doc_id is no smaller than any and has no smaller one, and no
label. Where doc_ids are null or repeated, the table is written once with a number for each row, and rows are told apart by that.
A document is good or toxic if any of its label rows says 1. An empty table has no part and gives no row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import split_join, stored, work_dir

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 100, 80, 10
SIGNS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Texts that occur more than once whose digests go to all tasks at most (40 bytes each); more are met in a shuffled join.
BROADCAST_TEXTS = 500_000
SETS = range(1 << len(FILTERS))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, text, part; the row is the doc_id where that is unique."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    ids = named.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return named.select(F.col("doc_id").alias("row"), "*")
    return stored(named.select(F.monotonically_increasing_id().alias("row"), "*"), work_dir(docs.sparkSession, "audit"), "rows")


def word_totals(dealt: DataFrame) -> DataFrame:
    """row, n_words, n_distinct; rows without a word are left out."""
    words = dealt.select("row", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    return words.groupBy("row", "word").agg(F.count("*").alias("n")).groupBy("row").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def first_ids(rows: DataFrame) -> DataFrame:
    """digest, first: the least doc_id of each text that more than one row holds."""
    groups = rows.select("doc_id", F.sha2("text", 256).alias("digest")).groupBy("digest")
    return groups.agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1 and first is not null").select("digest", "first")


def flagged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, set (bit k: fails filter k), good, toxic of every row."""
    dealt = rows.repartition("row")
    n = F.coalesce("n_words", F.lit(0))
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    signs = dealt.select(
        "row", "doc_id", "part", F.sha2("text", 256).alias("digest"), (capitals * 100 > F.length("text") * MAX_CAPITAL_PERCENT).alias("c"), F.col("text").rlike(SIGNS).alias("d")
    )
    totals = signs.join(word_totals(dealt), "row", "left")
    copies = stored(first_ids(rows), work_dir(rows.sparkSession, "audit"), "copies")
    few = copies.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    seen = totals.join(F.broadcast(copies), "digest", "left") if few else split_join(totals, copies, ["digest"], "left")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    judged = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    judged = seen.join(judged, "doc_id", "left")
    fails = [
        n < MIN_WORDS, F.coalesce("n_distinct", F.lit(0)) * 100 < n * MIN_DISTINCT_PERCENT, F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
    ]
    fail_set = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return judged.select("part", fail_set.alias("set"), F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def counted(flags: DataFrame) -> DataFrame:
    """part, n, good, toxic: 32 conditional counts each, in the order of the sets, as arrays."""
    count = lambda kind, k, of: F.count_if((F.col("set") == k) & of).alias(f"{kind}{k}")
    kinds = {"n": F.lit(True), "g": F.col("good"), "t": F.col("toxic")}
    wide = flags.groupBy("part").agg(*[count(kind, k, of) for kind, of in kinds.items() for k in SETS])
    return wide.select("part", *[F.array(*[f"{kind}{k}" for k in SETS]).alias(kind) for kind in kinds])


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, its filter's bit, the bits of the filters before it) of all orders."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(c) for c in order]
        out += [(order, k + 1, bits[k], sum(bits[:k])) for k in range(len(order))]
    return out


def total(counts: Column, chosen) -> Column:
    """The sum of the counts of the sets that `chosen` (set -> condition, or weight) picks."""
    weighed = F.transform(counts, lambda n, k: n * chosen(k).cast("long"))
    return F.aggregate(weighed, F.lit(0).cast("long"), lambda a, n: a + n)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part,
    order and step."""
    flags = flagged(numbered(docs), labels)
    listed = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("before")) for o, s, b, p in steps()])
    rows = counted(flags).select("*", F.inline(listed))
    bit, before = F.col("bit"), F.col("before")
    fails = lambda k: k.bitwiseAND(bit) != 0
    gone = lambda k: k.bitwiseAND(before) != 0
    here = lambda k: fails(k) & ~gone(k)
    orders = len(list(permutations(FILTERS)))
    # Of the filters that a set fails, each comes first in equally many orders, and that one removes it.
    first = lambda k: F.when(fails(k), F.floor(F.lit(orders) / F.bit_count(k))).otherwise(0)
    found = [
        total(F.col("n"), lambda k: ~gone(k) & ~fails(k)), total(F.col("n"), here), total(F.col("n"), lambda k: fails(k) & gone(k)), total(F.col("n"), lambda k: k == bit),
        total(F.col("g"), here), total(F.col("t"), here), total(F.col("n"), first),
    ]
    return rows.select("part", "filter_order", "step", *[c.alias(name) for name, c in zip(COUNTS, found, strict=True)])


ORACLE = r"""
WITH RECURSIVE judged AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
    FROM documents
), failing AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN texts.doc_id > first_id THEN 16 ELSE 0 END) AS mask
    FROM texts LEFT JOIN judged ON judged.doc_id = texts.doc_id
), sets AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, mask
), filters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
chosen AS (
    SELECT letter AS filter_order, 1 AS step, bit, 0 AS before FROM filters
    UNION ALL
    SELECT filter_order || letter, step + 1, filters.bit, before + chosen.bit FROM chosen JOIN filters ON NOT contains(filter_order, letter)
), orders AS (SELECT filter_order FROM chosen WHERE step = 5),
steps AS (
    SELECT orders.filter_order, chosen.step, chosen.bit, chosen.before FROM orders JOIN chosen ON starts_with(orders.filter_order, chosen.filter_order)
), outcome AS (
    SELECT part, filter_order, step, bit, n, good, toxic, mask, (mask & bit) <> 0 AS fails, (mask & before) <> 0 AS gone FROM steps CROSS JOIN sets
), audit AS (
    SELECT part, filter_order, step, any_value(bit) AS bit,
        sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
    FROM outcome GROUP BY part, filter_order, step
), by_filter AS (SELECT part, bit, sum(removed) AS shapley FROM audit GROUP BY part, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM audit JOIN by_filter USING (part, bit)
"""
