"""Lineage cuts that survive lost executors.

Intermediate tables are written as Parquet below the folder named by ``spark.checkpoint.dir``, which
driver and executors share.  Where that setting is absent a folder of this machine is taken, on a local
master only; a cluster without the setting is an error, as its executors share no local folder.

``Scratch`` holds the tables of one operator and removes them when the operator has made its result.
What a result still reads is removed when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_left: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, as a path that Spark's readers and writers take."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "plait-stage")
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/plait-{label}-{uuid.uuid4().hex}"


def folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder for files that go when the driver's Python ends."""
    path = new_path(spark, label)
    _left.add(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the table read back, so nothing above is computed again."""
    return stage_at(df, label)[0]


def stage_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``stage``, with the path, for tables that ``drop`` removes when they are used up."""
    spark = df.sparkSession
    path = new_path(spark, label)
    _left.add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a staged table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _left.discard(path)


#: Rows of a task of what is staged in ``spread``, and the bytes that a task reads of files or up to which partitions are joined.
ROWS, BYTES = 1 << 18, 8 << 20


@contextmanager
def spread(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is staged in the ``with`` block is read and shuffled in so many partitions that the rows of a task don't grow with ``rows``."""
    wanted = {"spark.sql.shuffle.partitions": max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)),
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": BYTES, "spark.sql.files.maxPartitionBytes": BYTES}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run in the ``with`` block removes its shuffle files when it ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, True)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class Scratch:
    """Staged tables that go when the ``with`` block ends; ``keep`` stages one that stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            drop(self.spark, path)

    def stage(self, df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
        """As ``stage``; where ``rows``, the most there can be, are few, they are dealt to few files when all is computed."""
        files = None if rows is None else max(1, -(-rows // ROWS))
        if files is not None and files < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.repartition(files)
        out, path = stage_at(df, label)
        self.paths.append(path)
        return out

    def forget(self, last: bool) -> None:
        """Remove the table staged last, or all those before it."""
        gone = self.paths[-1:] if last else self.paths[:-1]
        self.paths = self.paths[:-1] if last else self.paths[-1:]
        for path in gone:
            drop(self.spark, path)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        return stage(df, label)


@atexit.register
def _drop_left() -> None:
    spark = SparkSession.getActiveSession() if _left else None
    for path in list(_left) if spark is not None and spark.sparkContext._jsc is not None else []:
        drop(spark, path)
