"""A database folder: numbered manifests that name the Parquet folders of every index.

A commit writes new folders first and then the next manifest under a name that must not exist yet, so readers see a
version or the next one, and of two writers one fails. On object stores without an atomic create only one writer may
run at a time.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from lodestar.errors import AlreadyExists, IOFailure, NotFound


class Store:
    def __init__(self, spark: SparkSession, path: str, create_if_missing: bool = True, error_if_exists: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.root = self._path(self.path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        exists = self.fs.exists(self._path(f"{self.path}/manifests"))
        if not exists and not create_if_missing:
            raise NotFound(f"database path not found: {path}")
        if exists and error_if_exists:
            raise AlreadyExists(f"database path already exists: {path}")
        if not exists:
            self.fs.mkdirs(self._path(f"{self.path}/manifests"))
        self.version, self.indexes = self._load()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _load(self) -> tuple[int, dict]:
        found = self.fs.listStatus(self._path(f"{self.path}/manifests"))
        names = sorted(f.getPath().getName() for f in found if f.getPath().getName().endswith(".json"))
        if not names:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0]
        try:
            return int(names[-1].removesuffix(".json")), json.loads(text)
        except ValueError as e:
            raise IOFailure(f"unreadable manifest {names[-1]}") from e

    def refresh(self) -> None:
        self.version, self.indexes = self._load()

    def commit(self, indexes: dict) -> None:
        """Makes `indexes` the next version."""
        at = self._path(f"{self.path}/manifests/{self.version + 1:012d}.json")
        draft = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(indexes).encode()))
        out.close()
        try:
            if self.fs.exists(at) or not self.fs.rename(draft, at):
                raise IOFailure("another writer was first; refresh and try again")
        except Py4JJavaError as e:
            raise IOFailure(str(e.java_exception)) from e
        self.version, self.indexes = self.version + 1, indexes

    def write(self, df: DataFrame, sort: str | None = None) -> str:
        """The name of a new folder with the rows; with `sort`, files hold ranges of it, so a lookup reads few row groups."""
        name = f"data/{uuid.uuid4().hex}"
        if sort:
            df = df.repartitionByRange(sort).sortWithinPartitions(sort)
        df.write.parquet(f"{self.path}/{name}")
        return name

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def vacuum(self) -> int:
        """Deletes folders that no index names any more; how many. Readers of older versions must have ended."""
        used = {x for entry in self.indexes.values() for x in [entry.get("base"), *entry.get("deltas", []), *(entry.get("graph") or {}).values()] if isinstance(x, str)}
        folder = self._path(f"{self.path}/data")
        if not self.fs.exists(folder):
            return 0
        stale = [f.getPath() for f in self.fs.listStatus(folder) if f"data/{f.getPath().getName()}" not in used]
        for at in stale:
            self.fs.delete(at, True)
        return len(stale)
