"""Output schemas of Arrow functions, and rows packed so that no column name can clash."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def with_fields(df: DataFrame, columns: list[str], **added: str) -> StructType:
    """The fields ``columns`` of ``df`` and then ``added``, name by type."""
    out = StructType([df.schema[c] for c in columns])
    for name, kind in added.items():
        out = out.add(name, DataType.fromDDL(kind))
    return out


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, text: str = "text", *more: Column) -> DataFrame:
    """``rest``, a struct of all columns but the text, then ``text`` as a string and ``more``."""
    fields = [quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    return docs.select(F.struct(F.lit(0).alias("none"), *fields).alias("rest"), quoted(text).cast("string").alias("text"), *more)


def unpacked(docs: DataFrame, text: str = "text") -> list[Column]:
    """The columns of ``docs`` out of what ``packed`` made of it."""
    return [F.col("text").alias(c) if c == text else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that few texts at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def whole(docs: DataFrame) -> Column:
    """A struct of all columns, whose names then clash with nothing."""
    return F.struct(F.lit(0).alias("none"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])


def restored(docs: DataFrame, packed_as: str = "rest") -> list[Column]:
    """The columns of ``docs`` out of what ``whole`` made of it."""
    return [F.col(f"{packed_as}.c{i}").alias(c) for i, c in enumerate(docs.columns)]
