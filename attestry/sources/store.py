"""Versioned tables in one folder: what a commit names becomes visible together, and nothing else ever does."""

from __future__ import annotations

import json
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir; a local one in local mode only, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file:///tmp/checkpoints")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000, size: str = "16m"):
    """Smaller Arrow batches for the jobs run inside; the session's own setting comes back."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def few(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """rows for a join: broadcast where they were counted to be few, else shuffled."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


class Files:
    """Small files and folders through Spark's own file systems, so any path that Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self.at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(folder)))

    def put_new(self, name: str, text: str) -> bool:
        """Write a file whole under a name that is free; False where another writer has taken it."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        out = self._fs.create(self.at(part), False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(self.at(name)) or not self._fs.rename(self.at(part), self.at(name)):
            self._fs.delete(self.at(part), False)
            return False
        return True

    def get(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


class Conflict(RuntimeError):
    """Another writer committed since this one began."""


class Store:
    """Tables under root. Each version is one small manifest that names the folders of every table.

    Data folders are written first and never changed. A version exists once its manifest does,
    so a writer that dies at any step leaves the version before readable and whole. Of two
    writers that began from the same version the second one to commit raises Conflict.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("versions") if re.fullmatch(r"\d{12}\.json", n)]

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, by default the last: {"version", "tables": {name: [folder, ...]}, "schemas", "shown", "notes"}; version 0 has no tables."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "schemas": {}, "notes": {}}
        return json.loads(self.files.get(f"versions/{version:012d}.json"))

    def read(self, name: str, version: int | None = None, manifest: dict | None = None) -> DataFrame:
        manifest, out = manifest or self.manifest(version), None
        schema = StructType.fromJson(manifest["schemas"][name])
        for folder in manifest["tables"][name]:
            part = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")  # one by one, for a partitioned folder has its own root
            out = part if out is None else out.unionByName(part)
        shown = manifest.get("shown", {}).get(name)
        return out.selectExpr(*shown) if shown else out

    def begin(self) -> Change:
        return Change(self, self.manifest())

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete manifests but the last keep, and folders that no kept one names. For a time without writers or readers of older versions."""
        known = self.versions()
        for v in known[:-keep]:
            self.files.remove(f"versions/{v:012d}.json")
        named = {f for v in known[-keep:] for folders in self.manifest(v)["tables"].values() for f in folders}
        gone = [f"data/{n}" for n in self.files.names("data") if f"data/{n}" not in named]
        for f in gone:
            self.files.remove(f)
        return gone


class Change:
    """A version in the making."""

    def __init__(self, store: Store, base: dict) -> None:
        self.store, self.base = store, base
        self.tables = {k: list(v) for k, v in base["tables"].items()}
        self.schemas = dict(base["schemas"])
        #: Select lists of tables that are written without what their other columns tell, such as name-based ids.
        self.shown: dict[str, list[str]] = dict(base.get("shown", {}))

    def _write(self, name: str, rows: DataFrame, by: tuple[str, ...]) -> str:
        folder = f"data/{name}-{uuid.uuid4().hex}"
        self.schemas[name] = rows.schema.jsonValue()
        out = rows.write.option("compression", "zstd")  # name-based ids are hex digits, of which zstd saves half and snappy nothing
        out.partitionBy(*by).parquet(f"{self.store.root}/{folder}") if by else out.parquet(f"{self.store.root}/{folder}")
        return folder

    def replace(self, name: str, rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """The table becomes rows; returns them as readers see them."""
        self.tables[name] = [self._write(name, rows, by)]
        return self.read(name)

    def append(self, name: str, rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """rows join the table; returns those as written."""
        folder = self._write(name, rows, by)
        self.tables.setdefault(name, []).append(folder)
        return self.store.spark.read.schema(rows.schema).parquet(f"{self.store.root}/{folder}")

    def read(self, name: str) -> DataFrame:
        return self.store.read(name, manifest={"tables": self.tables, "schemas": self.schemas, "shown": self.shown})

    def commit(self, **notes) -> int:
        version = self.base["version"] + 1
        text = json.dumps({"version": version, "tables": self.tables, "schemas": self.schemas, "shown": self.shown, "notes": {**self.base["notes"], **notes}}, sort_keys=True)
        if not self.store.files.put_new(f"versions/{version:012d}.json", text):
            raise Conflict(f"version {version} was committed by another writer")
        return version
