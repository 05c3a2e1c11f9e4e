"""A store of rows with ids that is added to: chunks with their vectors, or any table.

A folder holds data files, a manifest for each commit (its data files), and numbered snapshots that name manifests. Tasks write data
files of their own through a data source writer; its commit writes the manifest and then the next snapshot, which must not be there
yet, and its abort deletes what was written. Readers take the files that a snapshot names, so those of failed or repeated tasks never count and
every version can be read again. Spark reads them as plain Parquet, with pruning and pushdown.

`Store.add` leaves out rows whose ids are there already. It looks at the ids of one snapshot and publishes on top of that
one; where another writer has come first, it looks again. `Store.compact` puts many small files together, in a new version.

Defined results: of rows of a batch with equal ids the least one (by its columns in order) is added; rows with a null id are not.
A batch without new ids makes no version. Columns are matched by name; one that is missing or has another type is an error.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.files import content, created, files_below, open_fs, removed
from tessera.tables import deleted, stored, work_dir

NAME = "tessera_store"
#: Bytes of a data file, as rows are in memory.
FILE_BYTES = 256 << 20
#: Ids that go to all tasks at most, to be looked for among those that are there; more are met in a shuffled join.
BROADCAST_IDS = 1_000_000
#: Times that another writer may come first.
TRIES = 20


class StoreConflict(RuntimeError):
    """Another writer has published a version meanwhile."""


@dataclass
class File(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


def snapshots(path: str) -> list[int]:
    return sorted(int(p.rsplit("/", 1)[-1][:-5]) for p, _ in files_below(f"{path}/snapshots", ".json"))


def snapshot(path: str, version: int | None = None) -> dict:
    """A version's snapshot, by default the newest."""
    if version is None:
        version = snapshots(path)[-1]
    return json.loads(content(f"{path}/snapshots/{version:010d}.json"))


def data_files(path: str, found: dict) -> list[dict]:
    return [f for m in found["manifests"] for f in json.loads(content(f"{path}/manifests/{m}.json"))]


def published(path: str, base: dict, manifests: list[str], rows: int) -> int:
    """The next version's number."""
    version = base["version"] + 1
    body = {**base, "version": version, "manifests": manifests, "rows": rows}
    if not created(f"{path}/snapshots/{version:010d}.json", json.dumps(body).encode()):
        raise StoreConflict(f"version {version} is there already")
    return version


class StoreSource(DataSource):
    """Options: path; version (reading); base, the version that rows are added to, and replace (writing)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return StructType.fromJson(snapshot(self.options["path"])["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return StoreReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return StoreWriter(self.options, schema, overwrite)


class StoreReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.version = int(options["version"]) if "version" in options else None

    def partitions(self) -> list[File]:
        return [File(f["name"]) for f in data_files(self.path, snapshot(self.path, self.version))]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(self.path)
        with fs.open_input_file(f"{top}/data/{partition.path}") as f:
            yield from pq.ParquetFile(f).iter_batches()


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path = options["path"]
        self.base = snapshot(self.path, int(options["base"]) if "base" in options else None)
        self.replace = overwrite or options.get("replace", "false").lower() == "true"
        wanted = StructType.fromJson(self.base["schema"])
        if [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in wanted]:
            raise ValueError(f"the store holds {wanted.simpleString()}, not {schema.simpleString()}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = open_fs(self.path)
        fs.create_dir(f"{top}/data", recursive=True)
        files: list[dict] = []
        out = None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    files.append({"name": f"{uuid.uuid4().hex}.parquet", "rows": 0, "bytes": 0})
                    out = pq.ParquetWriter(f"{top}/data/{files[-1]['name']}", batch.schema, filesystem=fs, compression="zstd")
                out.write_batch(batch)
                files[-1]["rows"] += batch.num_rows
                files[-1]["bytes"] += batch.nbytes
                if files[-1]["bytes"] >= FILE_BYTES:
                    out.close()
                    out = None
            if out:
                out.close()
        except BaseException:
            removed(f"{self.path}/data", [f["name"] for f in files])
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        rows = sum(f["rows"] for f in files)
        if not rows and not self.replace:
            return
        manifest = uuid.uuid4().hex
        created(f"{self.path}/manifests/{manifest}.json", json.dumps(files).encode())
        try:
            published(self.path, self.base, [manifest] if self.replace else [*self.base["manifests"], manifest], rows + (0 if self.replace else self.base["rows"]))
        except StoreConflict:
            removed(f"{self.path}/manifests", [f"{manifest}.json"])
            self.abort(messages)
            raise

    def abort(self, messages: list[Written | None]) -> None:
        removed(f"{self.path}/data", [f["name"] for m in messages if m for f in m.files])


@dataclass(frozen=True)
class Store:
    """A store below a path that workers reach as well."""

    spark: SparkSession
    path: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, key: str = "id") -> Store:
        """A new store without rows (version 0); an error where there is one."""
        kind = spark.createDataFrame([], schema).schema
        plain = StructType.fromJson(json.loads(kind.json()))
        for field in plain:
            field.nullable = True
        if key not in plain.fieldNames():
            raise ValueError(f"no column {key}")
        first = {"version": -1, "manifests": [], "rows": 0, "key": key, "schema": json.loads(plain.json())}
        published(path, first, [], 0)
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        """A store that is there."""
        spark.dataSource.register(StoreSource)
        if not snapshots(path):
            raise FileNotFoundError(path)
        return cls(spark, path)

    def versions(self) -> list[int]:
        return snapshots(self.path)

    def count(self, version: int | None = None) -> int:
        """The rows of a version, which its snapshot tells."""
        return snapshot(self.path, version)["rows"]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, read as Parquet."""
        found = snapshot(self.path, version)
        schema = StructType.fromJson(found["schema"])
        files = [f"{self.path}/data/{f['name']}" for f in data_files(self.path, found)]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def add(self, rows: DataFrame) -> int:
        """Add the rows whose ids are not there yet; returns how many. Safe beside other writers."""
        key, names = (base := snapshot(self.path))["key"], [f["name"] for f in base["schema"]["fields"]]
        folder = work_dir(self.spark, "store")
        batch = stored(rows.select(*names), folder, "batch")  # it is read several times
        try:
            for k in range(TRIES):
                base = snapshot(self.path)
                fresh = stored(self.missing(batch, key, base["version"]), folder, f"fresh-{k}")
                n = fresh.count()
                try:
                    if n:
                        fresh.write.format(NAME).mode("append").option("base", base["version"]).save(self.path)
                    return n
                except Exception as e:
                    if "StoreConflict" not in str(e):
                        raise
        finally:
            deleted(self.spark, folder, "batch", *[f"fresh-{k}" for k in range(TRIES)])
        raise StoreConflict(f"other writers came first {TRIES} times")

    def missing(self, rows: DataFrame, key: str, version: int) -> DataFrame:
        """One row for each new id."""
        names = rows.columns
        once = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*names)).alias("row")).select("row.*")
        known = self.read(version).select(key)
        if rows.select(key).limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
            return once.join(known, key, "left_anti").select(*names)
        met = known.join(F.broadcast(rows.select(key)), key, "left_semi")
        return once.join(F.broadcast(met), key, "left_anti").select(*names)

    def compact(self) -> int:
        """Put the files together, in a new version of the same rows; returns its number."""
        base = snapshot(self.path)
        files = data_files(self.path, base)
        parts = max(1, -(-sum(f["bytes"] for f in files) // FILE_BYTES))
        rows = self.read(base["version"]).repartition(parts)
        rows.write.format(NAME).mode("append").option("base", base["version"]).option("replace", "true").save(self.path)
        return base["version"] + 1

    def vacuum(self, seconds: float = 7 * 86400.0) -> int:
        """Delete data files that no manifest names and that are older: what killed tasks have left, and could still be writing if younger.

        Returns how many.
        """
        fs, top = open_fs(self.path)
        named = {f["name"] for path, _ in files_below(f"{self.path}/manifests", ".json") for f in json.loads(fs.open_input_file(path).read())}
        found = fs.get_file_info(pafs.FileSelector(f"{top}/data", allow_not_found=True))
        gone = [f.base_name for f in found if f.is_file and f.base_name not in named and f.mtime_ns / 1e9 <= time.time() - seconds]
        removed(f"{self.path}/data", gone)
        return len(gone)
