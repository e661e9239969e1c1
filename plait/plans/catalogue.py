"""Named tables below one folder, so that a chain of stages goes on where it was interrupted.

A table is written under a name of its own first; then its manifest (path, schema, key) is renamed into place, which the
file system does as a whole or not at all.  What has a manifest is therefore complete, and what was being written when the driver
died has none and is written again.  The manifest with the highest number holds; older ones and their tables go after it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plait.plans.staging import drop


def key_of(*parts) -> str:
    """A key for parameters and the keys of inputs: equal for equal values of strings, numbers, lists and dicts."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def fingerprint(df: DataFrame) -> str:
    """A key for the rows of a table, whatever their order: their number and two sums of hashes, from one pass."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")) for seed in (1, 2)]
    return key_of(df.schema.json(), *map(str, df.agg(F.count("*"), *sums).first()))


class Catalogue:
    """The named tables of the folder ``root``, any path that Spark can write to and rename in."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.made: list[str] = []

    def _path(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _manifests(self, name: str) -> list[str]:
        """Paths of a table's manifests, the newest first."""
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"a table's name has letters, digits and underscores only: {name!r}")
        fs, folder = self._path(f"{self.root}/manifests/{name}")
        found = [str(s.getPath().toString()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted((p for p in found if p.endswith(".json")), reverse=True)

    def _read(self, path: str) -> dict:
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def manifest(self, name: str) -> dict | None:
        """The table's manifest, or None."""
        found = self._manifests(name)
        return self._read(found[0]) if found else None

    def load(self, name: str) -> DataFrame:
        """The table ``name``; a KeyError where there is none."""
        held = self.manifest(name)
        if held is None:
            raise KeyError(name)
        return self.spark.read.schema(StructType.fromJson(held["schema"])).parquet(held["path"])

    def save(self, name: str, df: DataFrame, key: str = "") -> DataFrame:
        """Write ``df`` as the table ``name`` and return it as read back; an older table of the name goes when the new one is there."""
        old = self._manifests(name)
        path = f"{self.root}/tables/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        number = int(old[0].rpartition("/")[2][:-5]) + 1 if old else 0
        fs, draft = self._path(f"{self.root}/manifests/{name}/{uuid.uuid4().hex}.draft")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"path": path, "key": key, "schema": df.schema.jsonValue()}).encode()))
        out.close()
        if not fs.rename(draft, self._path(f"{self.root}/manifests/{name}/{number:012d}.json")[1]):
            raise RuntimeError(f"another writer has committed table {name} meanwhile")
        for manifest in old:
            gone = self._read(manifest)["path"]
            drop(self.spark, manifest)
            drop(self.spark, gone)
        return self.load(name)

    def step(self, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table ``name`` if it was committed under ``key``, else what ``make`` returns, committed under it."""
        held = self.manifest(name)
        if held and held["key"] == key:
            return self.load(name)
        self.made.append(name)
        return self.save(name, make(), key)

    def names(self) -> list[str]:
        """All tables that are there, by name."""
        fs, folder = self._path(f"{self.root}/manifests")
        found = [str(s.getPath().getName()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(n for n in found if self._manifests(n))

    def remove(self, name: str) -> None:
        """Drop a table with its manifests; nothing happens where there is none."""
        for manifest in self._manifests(name):
            gone = self._read(manifest)["path"]
            drop(self.spark, manifest)
            drop(self.spark, gone)
