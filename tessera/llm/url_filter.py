"""URL filters: rules first, then link-graph propagation over hosts for what no rule judges.

Rules name a host (with all its subdomains) and the start of a path; the longest that fits wins. For all other pages
the host decides. Links between hosts are counted into a weighted graph (a host's links to itself included, and one
more, so that no host is a dead end). Trust is personalised PageRank from the hosts of pages that a rule allows,
weighted by their number; distrust is the same over reversed edges from the hosts of blocked pages. A host is blocked
when distrust makes up more than `THRESHOLD` of both. Ranks are carried on until none changes and no further host is
reached, so over paths of any length (as far as a rank is above `LEAST`). Hosts that neither reaches are allowed.

Defined results: a null url or one without `://` has an empty host and path, no rule, and is allowed; empty hosts are
in no link; null html has no links; rows are judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import deleted, split_join, stored, work_dir

#: verdict, host, start of the path. Evaluated for every page, so meant for some hundred rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
#: Rounds at least; after them, rounds go on until a table of ranks agrees with the one before.
ROUNDS = 20
ROUNDS_PER_TABLE = 5
#: Change of a rank that counts, relative to it, and the least one that floating-point numbers tell apart safely.
TOLERANCE, LEAST = 1e-6, 1e-300
THRESHOLD = 0.5
#: Hosts whose verdicts are sent to all tasks at most; more are met in a shuffled join.
BROADCAST_HOSTS = 200_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(length, rule, verdict) of the longest fitting rule, or null."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from pages of one host to another; relative links stay on the host."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    links = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]*)"""), 1)
    host = host_of(F.col("url").cast("string"))
    rows = pages.select(host.alias("src"), F.explode(links).alias("link")).where("src <> ''")
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).when(F.col("link").rlike("(?i)^https?://"), F.col("link"))
    scheme = F.col("link").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & absolute.isNull()
    dst = F.when(scheme, F.lit("")).otherwise(F.coalesce(host_of(absolute), F.col("src")))
    dst = F.when(absolute.isNull() & ~scheme, F.col("src")).otherwise(dst)
    return rows.select("src", dst.alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, folder: str, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust. edges: src, dst, n; seeds: host, allowed, blocked (numbers of pages)."""
    hosts = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("host")).distinct()
    loops = hosts.select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1).cast("long").alias("n"))
    both = edges.union(loops).groupBy("src", "dst").agg(F.sum("n").cast("double").alias("n"))
    directed = both.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(both.select(F.lit("distrust"), "dst", "src", "n"))
    out = directed.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    shares = stored(directed.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), folder, "shares")
    totals = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    part = lambda c, total: F.coalesce(F.col(c), F.lit(0)) / F.lit(float(total or 1))
    start = hosts.join(seeds, "host", "left").select(
        "host", F.explode(F.create_map(F.lit("trust"), part("allowed", totals.a), F.lit("distrust"), part("blocked", totals.b))).alias("kind", "seed")
    )
    start = stored(start, folder, "seeds")
    rank = before = start.withColumn("rank", F.col("seed"))
    for k in count(1):
        moved = split_join(shares, rank.select("kind", F.col("host").alias("src"), "rank"), ["kind", "src"])
        got = moved.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = start.join(got, ["kind", "host"], "left").select(
            "kind", "host", "seed", (F.lit(1 - DAMPING) * F.col("seed") + F.lit(DAMPING) * F.coalesce("got", F.lit(0.0))).alias("rank")
        )
        if k % ROUNDS_PER_TABLE == 0:
            rank = stored(rank, folder, f"rank-{k}")
            if k >= rounds and settled(before, rank):
                break
            deleted(start.sparkSession, folder, f"rank-{k - ROUNDS_PER_TABLE}")
            before = rank
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    return rank.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def settled(before: DataFrame, rank: DataFrame) -> bool:
    both = rank.join(before.select("kind", "host", F.col("rank").alias("was")), ["kind", "host"])
    return both.where(F.abs(F.col("rank") - F.col("was")) > F.greatest(F.lit(TOLERANCE) * F.col("rank"), F.lit(LEAST))).isEmpty()


def host_verdicts(pages: DataFrame, rules, folder: str) -> DataFrame:
    """host, trust, distrust, verdict."""
    pages_of = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0))
    seeds = judged(pages, rules).where("host <> ''").groupBy("host").agg(pages_of("allow").alias("allowed"), pages_of("block").alias("blocked"))
    seeds = stored(seeds, folder, "judged-hosts")
    edges = stored(host_edges(pages), folder, "edges")
    found = propagated(edges, seeds, folder)
    block = F.col("distrust") > F.lit(THRESHOLD) * (F.col("trust") + F.col("distrust"))
    return found.withColumn("host_verdict", F.when(block, "block").otherwise("allow"))


def url_verdicts(pages: DataFrame, rules=RULES, folder: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    folder = folder or work_dir(pages.sparkSession, "url-filter")
    hosts = stored(host_verdicts(pages, rules, folder).select("host", "host_verdict"), folder, "hosts")
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    rows = judged(pages, rules).join(F.broadcast(hosts) if few else hosts, "host", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", "host_verdict", F.lit("allow")).alias("verdict"))
