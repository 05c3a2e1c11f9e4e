"""Approximate nearest neighbours: navigable graphs in the cells of a coarse quantiser, written once and reopened.

The quantiser's centres are fitted by Lloyd's rounds in Spark on a bounded sample; every row goes to its nearest centre. A
cell is dealt out to shards of bounded size, so that a cell with a third of all rows is many tasks, and each shard becomes one
graph, a row of a Parquet table. A graph's nodes are the distinct vectors of its shard, with the ids that share one; its edges
go to near nodes that no kept neighbour is nearer to, then to the nearest others, and back. Every node can be reached from the
graph's entries.

A search sends each question to the shards of its nearest cells alone, in groups of bounded size, walks the graphs of a group
in step, and keeps the best of all. How many cells are looked into is measured when the index is built: the fewest that hold
the wanted share of the true neighbours of a sample of rows. `retrieval.top_k_dense` is the exact search beside it.

Defined results: vectors that are null, empty, of another length than the most, or hold null or non-finite entries are not in the index, and
such questions get no row. Scores are cosines, 0 for a vector without length; of equal scores the least id comes first. Rows with equal ids are
found one by one. An index over an empty table has no cell and gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.config import DEFAULTS
from tessera.operators.retrieval import DIGITS, ranked, top_k_dense
from tessera.tables import deleted, stored, work_dir

#: Rows of a cell on average; cells at most, and bytes of their centres, which go to all tasks.
CELL_ROWS = 4096
MAX_CELLS = 65_536
CENTRE_BYTES = 64 << 20
#: Rows of the quantiser's sample for each cell, and rounds of its fit.
SAMPLE_A_CELL = 64
ROUNDS = 6
#: Rows of a shard: half as many on average, so that dealing by hash keeps below it.
SHARD_ROWS = 16_384
#: Nearest nodes that edges are chosen from, edges of a node before those that lead back, and with them.
NEAREST = 64
DEGREE = 24
LINKS = 48
#: Nodes that a walk keeps, and those it goes on from in a step; graphs of fewer nodes are scored whole.
BEAM = 96
STEP = 4
WHOLE = 512
#: Questions of a group, and those that walk in step.
QUESTIONS = 2048
TOGETHER = 256
#: The share of true neighbours whose cells are looked into, and the rows that it is measured on.
TARGET = 0.97
MEASURED = 256
#: Cells that are named to the reader at most; with more it reads all.
NAMED_CELLS = 500


def unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (m / np.where(length == 0, 1.0, length)).astype(np.float32)


def usable(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v of the rows that can be indexed, the length of their vectors; 0 where there are none)."""
    named = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v")).where("size(v) > 0")
    fine = named.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    first = fine.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    length = first[0]["length"] if first else 0
    return fine.where(F.size("v") == length), length


def matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, length)


def nearest_cells(m: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    distance = (centres**2).sum(axis=1)[None, :] - 2 * unit(m) @ centres.T
    if k == 1:
        return distance.argmin(axis=1)[:, None]
    near = np.argpartition(distance, min(k, len(centres) - 1), axis=1)[:, :k]
    return np.take_along_axis(near, np.take_along_axis(distance, near, 1).argsort(axis=1, kind="stable"), 1)


def some_vectors(rows: DataFrame, n: int, wanted: int, salt: int) -> DataFrame:
    """v: about as many of the distinct vectors of n rows as are wanted, or fewer where vectors repeat; the same ones each time."""
    places = 1 << 30
    share = min(places, math.ceil(places * wanted / max(n, 1)))
    return rows.select("v").where(F.pmod(F.xxhash64("v", F.lit(salt)), F.lit(places)) < share).distinct()


def fitted_centres(rows: DataFrame, n: int, length: int) -> np.ndarray:
    """Centres of the cells (rows of a matrix), by Lloyd's rounds on a sample of SAMPLE_A_CELL rows a cell."""
    spark = rows.sparkSession
    cells = max(1, min(MAX_CELLS, CENTRE_BYTES // (4 * length), -(-n // CELL_ROWS)))
    if cells == 1:
        return np.zeros((1, length), np.float32)
    folder = work_dir(spark, "quantiser")
    sample = stored(some_vectors(rows, n, SAMPLE_A_CELL * cells, 0), folder, "sample")
    first = sample.orderBy(F.xxhash64("v", F.lit(1))).limit(cells).collect()
    centres = unit(np.array([r["v"] for r in first], np.float32).reshape(-1, length))
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(sent.value.shape), np.zeros(len(sent.value), np.int64)
            for batch in batches:
                m = matrix(batch.column(0), length)
                cell = nearest_cells(m, sent.value)[:, 0]
                np.add.at(total, cell, unit(m))
                count += np.bincount(cell, minlength=len(count))
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(met, length)), pa.array(np.tile(np.arange(length), len(met))), pa.array(total[met].ravel()), pa.array(np.repeat(count[met], length))
            ], ["cell", "j", "s", "n"])

        found = sample.mapInArrow(sums, "cell long, j long, s double, n long").groupBy("cell", "j").agg((F.sum("s") / F.sum("n")).alias("c"))
        moved = centres.copy()
        for cell, j, c in found.toLocalIterator():
            moved[cell, j] = c
        still = np.allclose(moved, centres, atol=1e-5)
        centres = moved
        if still:
            break
    deleted(spark, folder, "sample")
    return centres


def occluded(near: np.ndarray, scores: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Which candidates (nearest first) of each node are kept: those that no kept one is nearer to, then the nearest others."""
    own = vectors[near]
    between = own @ own.transpose(0, 2, 1)
    kept = np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        hidden = (kept & (between[:, j, :] > scores[:, j, None])).any(axis=1)
        kept[:, j] = ~hidden & (kept.sum(axis=1) < DEGREE)
    spare = DEGREE - kept.sum(axis=1, keepdims=True)
    return kept | (~kept & ((~kept).cumsum(axis=1) <= spare))


def graph(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links, entries) of a graph over unit vectors: links has LINKS columns, -1 where there is none."""
    n = len(vectors)
    k = min(NEAREST, n - 1)
    source, target, score = [], [], []
    for at in range(0, n if k else 0, 512):
        own = np.arange(at, min(at + 512, n))
        s = vectors[own] @ vectors.T
        s[np.arange(len(own)), own] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        scores = np.take_along_axis(s, near, 1)
        order = (-scores).argsort(axis=1, kind="stable")
        near, scores = np.take_along_axis(near, order, 1), np.take_along_axis(scores, order, 1)
        q, c = np.nonzero(occluded(near, scores, vectors))
        source.append(own[q])
        target.append(near[q, c])
        score.append(scores[q, c])
    links = np.full((n, LINKS), -1, np.int32)
    if source:
        a, b, s = np.concatenate(source), np.concatenate(target), np.concatenate(score)
        back = np.repeat([0, 1], len(a))  # edges that lead back come after a node's own
        a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
        _, once = np.unique(a.astype(np.int64) * n + b, return_index=True)
        once = once[np.lexsort((-s[once], back[once], a[once]))]
        place = np.arange(len(once)) - np.searchsorted(a[once], a[once])
        fits = place < LINKS
        links[a[once][fits], place[fits]] = b[once][fits]
    return links, entries(links, int((vectors @ vectors.mean(axis=0)).argmax()) if n else 0)


def entries(links: np.ndarray, first: int) -> np.ndarray:
    """Nodes from which all others are reached, the first one among them."""
    reached = np.zeros(len(links), bool)
    found = []
    while not reached.all():
        start = first if not found else int(np.flatnonzero(~reached)[0])
        found.append(start)
        front = np.array([start])
        reached[front] = True
        while len(front):
            near = np.unique(links[front])
            front = near[(near >= 0) & ~reached[near]]
            reached[front] = True
    return np.array(found, np.int32)


def walked(vectors: np.ndarray, links: np.ndarray, starts: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores) of the best nodes of each question (a row), -1 behind the last; all walk in step."""
    n, width = len(vectors), max(BEAM, k)
    if n <= max(WHOLE, width):
        scores = asked @ vectors.T
        nodes = (-scores).argsort(axis=1, kind="stable")[:, :k]
        return nodes, np.take_along_axis(scores, nodes, 1)
    rows = np.arange(len(asked))[:, None]
    seen = np.zeros((len(asked), n + 1), bool)  # the last place is that of links that lead nowhere
    seen[:, n] = True
    beam = np.full((len(asked), width), n)
    scores = np.full((len(asked), width), -np.inf, np.float32)
    done = np.ones((len(asked), width), bool)

    def meet(nodes: np.ndarray) -> None:
        nonlocal beam, scores, done
        nodes = np.sort(np.where(nodes < 0, n, nodes), axis=1)
        new = ~seen[rows, nodes]
        new[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
        seen[rows, nodes] = True
        s = np.where(new, (vectors[np.minimum(nodes, n - 1)] @ asked[:, :, None])[:, :, 0], -np.inf)
        all_nodes, all_scores = np.hstack([beam, nodes]), np.hstack([scores, s])
        best = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        beam, scores = np.take_along_axis(all_nodes, best, 1), np.take_along_axis(all_scores, best, 1)
        done = np.take_along_axis(np.hstack([done, ~new]), best, 1)

    meet(np.broadcast_to(starts, (len(asked), len(starts))))
    while not done.all():
        next_ = np.argpartition(np.where(done, np.inf, -scores), STEP - 1, axis=1)[:, :STEP]
        go = ~np.take_along_axis(done, next_, 1)
        np.put_along_axis(done, next_, True, 1)
        from_ = np.where(go, np.take_along_axis(beam, next_, 1), -1)
        near = links[np.maximum(from_, 0) % n]
        near[~go | (from_ >= n)] = -1
        meet(near.reshape(len(asked), -1))
    order = (-scores).argsort(axis=1, kind="stable")[:, :k]
    nodes, scores = np.take_along_axis(beam, order, 1), np.take_along_axis(scores, order, 1)
    return np.where(np.isfinite(scores), nodes, -1), scores


def shard_row(ids: pa.Array, m: np.ndarray) -> dict:
    """What is stored of a shard: vectors of the nodes, where the ids of each begin, ids, links, entries."""
    nodes, node = np.unique(m, axis=0, return_inverse=True)
    own = pa.table({"node": node.ravel(), "id": ids}).sort_by([("node", "ascending"), ("id", "ascending")])
    begin = np.searchsorted(own["node"].to_numpy(), np.arange(len(nodes) + 1)).astype(np.int32)
    links, starts = graph(unit(nodes))
    return {"ids": own["id"].to_pylist(), "begin": begin.tobytes(), "vectors": nodes.astype("<f4").tobytes(), "links": links.tobytes(), "entries": starts.tobytes()}


def found_in(shard: dict, asked: np.ndarray, k: int) -> tuple[list, list, list]:
    """(question's place, id, score) of the k best rows of a shard for each question."""
    nodes = np.frombuffer(shard["vectors"], "<f4").reshape(-1, asked.shape[1])
    links, begin = np.frombuffer(shard["links"], np.int32).reshape(-1, LINKS), np.frombuffer(shard["begin"], np.int32)
    vectors, starts = unit(nodes), np.frombuffer(shard["entries"], np.int32)
    length = np.sqrt((nodes.astype(np.float64) ** 2).sum(axis=1))
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(asked), TOGETHER):
        part = asked[at : at + TOGETHER].astype(np.float64)
        best, _ = walked(vectors, links, starts, unit(part), k)
        q, c = np.nonzero(best >= 0)
        node = best[q, c]
        both = length[node] * np.sqrt((part[q] ** 2).sum(axis=1))
        score = np.round((nodes[node].astype(np.float64) * part[q]).sum(axis=1) / np.where(both == 0, 1.0, both), DIGITS)
        for i, x, s in zip((q + at).tolist(), node.tolist(), score.tolist(), strict=True):
            ids = shard["ids"][begin[x] : min(begin[x + 1], begin[x] + k)]
            out[0].extend([i] * len(ids))
            out[1].extend(ids)
            out[2].extend([s] * len(ids))
    return out


@dataclass(frozen=True)
class GraphIndex:
    """A written index: `cells` (cell, centre), `graphs` (cell, shard, ...) and `settings` (length, probes) below a path."""

    spark: SparkSession
    path: str
    length: int
    probes: int
    centres: np.ndarray

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GraphIndex:
        (settings,) = spark.read.parquet(f"{path}/settings").collect()
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        return cls(spark, path, settings["length"], settings["probes"], np.array([r["centre"] for r in rows], np.float32).reshape(len(rows), settings["length"]))

    @classmethod
    def build(cls, rows: DataFrame, key: str, path: str, vector: str = "embedding", k: int = DEFAULTS.top_k, target: float = TARGET) -> GraphIndex:
        """Index all rows below a path that is not there yet."""
        spark = rows.sparkSession
        fine, length = usable(rows, key, vector)
        centres = fitted_centres(fine, fine.count(), length) if length else np.zeros((0, 0), np.float32)
        centre_rows = [(i, c.tolist()) for i, c in enumerate(centres)]
        spark.createDataFrame(centre_rows, "cell int, centre array<float>").write.parquet(f"{path}/cells")
        index = cls(spark, path, length, 1, centres)
        folder = work_dir(spark, "index")
        assigned = index.append(fine, "build", folder)
        probes = index.measured_probes(assigned, k, target) if len(centres) > 1 else 1
        deleted(spark, folder, "assigned")
        spark.createDataFrame([(length, probes)], "length int, probes int").coalesce(1).write.parquet(f"{path}/settings")
        return cls.open(spark, path)

    def add(self, rows: DataFrame, key: str, batch: str, vector: str = "embedding") -> None:
        """Add graphs of further rows to the cells that are there. A batch has a name of its own."""
        fine, length = usable(rows, key, vector)
        if length != self.length:
            raise ValueError(f"the index holds vectors of length {self.length}, not {length}")
        folder = work_dir(self.spark, "index")
        self.append(fine, batch, folder)
        deleted(self.spark, folder, "assigned")

    def append(self, fine: DataFrame, batch: str, folder: str) -> DataFrame:
        """Write the graphs of rows (id, v); returns id, v, cell, a table `assigned` in the folder."""
        length = self.length
        kind = fine.schema["id"].dataType.simpleString()
        graphs = f"cell int, shard string, ids array<{kind}>, begin binary, vectors binary, links binary, entries binary"
        if not length:
            self.spark.createDataFrame([], graphs).write.parquet(f"{self.path}/graphs")
            return self.spark.createDataFrame([], f"id {kind}, v array<float>, cell int")
        sent = self.spark.sparkContext.broadcast(self.centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = nearest_cells(matrix(b.column(1), length), sent.value)[:, 0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

        assigned = stored(fine.select("id", "v").mapInArrow(assign, f"id {kind}, v array<float>, cell int"), folder, "assigned")
        shards = assigned.groupBy("cell").agg(F.ceil(F.count("*") * 2 / SHARD_ROWS).alias("shards"))  # a row a cell
        dealt = assigned.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(shards), "cell")
        dealt = dealt.select("cell", F.concat_ws("-", F.lit(batch), F.pmod(F.xxhash64("row"), "shards").cast("string")).alias("shard"), "id", "v")
        schema = pa.schema([("cell", pa.int32()), ("shard", pa.string()), ("ids", pa.list_(to_arrow_type(fine.schema["id"].dataType))), *[(c, pa.binary()) for c in ("begin", "vectors", "links", "entries")]])

        def build(key: tuple, rows: pa.Table) -> pa.Table:
            made = shard_row(rows["id"].combine_chunks(), matrix(rows["v"], length))
            return pa.Table.from_pylist([{"cell": key[0].as_py(), "shard": key[1].as_py(), **made}], schema)

        made = dealt.groupBy("cell", "shard").applyInArrow(build, graphs)
        made.write.mode("append").parquet(f"{self.path}/graphs")
        return assigned

    def measured_probes(self, assigned: DataFrame, k: int, target: float) -> int:
        """The fewest nearest cells of a row that hold the wanted share of its k nearest rows, over MEASURED rows."""
        sample = some_vectors(assigned, assigned.count(), 4 * MEASURED, 2).orderBy(F.xxhash64("v", F.lit(3))).limit(MEASURED)
        asked = sample.select(F.monotonically_increasing_id().alias("qid"), F.col("v").alias("qv"))
        asked = self.spark.createDataFrame(asked.collect(), "qid long, qv array<float>")
        near = top_k_dense(assigned, "id", asked.withColumnRenamed("qv", "v"), "qid", k, "v")
        held = near.join(assigned.select("id", "cell"), "id").groupBy("qid").agg(F.collect_list("cell").alias("cells"))
        order = {r["qid"]: r["qv"] for r in asked.collect()}
        places = []
        for qid, cells in held.collect():  # MEASURED rows of k cells
            ranks = np.argsort(nearest_cells(np.array([order[qid]], np.float32), self.centres, len(self.centres))[0])
            places += [int(ranks[c]) + 1 for c in cells]
        return int(np.quantile(places, target, method="higher")) if places else 1

    def search(self, questions: DataFrame, qid: str, k: int = DEFAULTS.top_k, vector: str = "embedding", probes: int | None = None) -> DataFrame:
        """qid, rank, id, score: the best k rows for each question, as far as the walks find them."""
        graphs, listed = (self.spark.read.parquet(f"{self.path}/graphs") for _ in range(2))
        kind, qkind = graphs.schema["ids"].dataType.elementType.simpleString(), questions.schema[qid].dataType.simpleString()
        if not self.length:
            return self.spark.createDataFrame([], f"{qid} {qkind}, rank int, id {kind}, score double")
        arrow = to_arrow_type(graphs.schema["ids"].dataType.elementType)
        length, many = self.length, min(probes or self.probes, len(self.centres))
        sent = self.spark.sparkContext.broadcast(self.centres)
        asked = questions.select(F.col(qid).alias("q"), F.col(vector).cast("array<float>").alias("v")).where(F.size("v") == length)
        asked = asked.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = nearest_cells(matrix(b.column(1), length), sent.value, many)
                each = pa.array(np.repeat(np.arange(len(cells)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(each), b.column(1).take(each), pa.array(cells.ravel().astype(np.int32))], ["q", "v", "cell"])

        folder = work_dir(self.spark, "search")
        probed = stored(asked.mapInArrow(probe, f"q {qkind}, v array<float>, cell int"), folder, "probed")
        parts = probed.groupBy("cell").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("parts"))  # a row a cell at most
        cells = [r["cell"] for r in parts.limit(NAMED_CELLS + 1).collect()]
        if len(cells) <= NAMED_CELLS:
            graphs, listed = (x.where(F.col("cell").isin(cells)) for x in (graphs, listed))
        parts = F.broadcast(parts)
        dealt = probed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("q", "v"), "parts").cast("int"))
        left = dealt.join(listed.select("cell", "shard"), "cell").select("cell", "shard", "part", "q", "v")
        right = graphs.join(parts, "cell").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

        def walk(asked: pa.Table, shard: pa.Table) -> pa.Table:
            places, ids, scores = found_in(shard.to_pylist()[0], matrix(asked["v"], length), k) if asked.num_rows and shard.num_rows else ([], [], [])
            return pa.table({"q": asked["q"].take(pa.array(places, pa.int64())), "id": pa.array(ids, arrow), "score": pa.array(scores, pa.float64())})

        keys = ["cell", "shard", "part"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(walk, f"q {qkind}, id {kind}, score double")
        return ranked(found, "q", "id", k).select(F.col("q").alias(qid), "rank", "id", "score")


def recall(found: DataFrame, exact: DataFrame, qid: str, key: str) -> DataFrame:
    """questions, wanted, found, recall: how many of the exact neighbours were found."""
    hit = exact.select(qid, key).join(found.select(qid, F.col("id").alias(key)).withColumn("hit", F.lit(1)), [qid, key], "left")
    return hit.agg(F.countDistinct(qid).alias("questions"), F.count("*").alias("wanted"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))

