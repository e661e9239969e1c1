"""Vectors that can be worked with: rows of one length whose components are all finite numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm.schemas import quoted


def usable(table: DataFrame, vec_id: str, embedding: str, parts: int = 1, **more: str) -> tuple[DataFrame, int]:
    """(id, ``more`` by new name, v) of the rows that can be used, with v of floats or doubles, and the length of v.

    Vectors that are null, empty or hold null or non-finite components go.  Of the lengths that ``parts`` divides
    the commonest counts (of several the longest); vectors of other lengths can't be compared with it and go too.
    The length is 0 where no row is left.
    """
    kind = "array<float>" if table.select(quoted(embedding)).dtypes[0][1] == "array<float>" else "array<double>"
    held = table.select(quoted(vec_id).alias("id"), *[quoted(c).alias(n) for n, c in more.items()], quoted(embedding).cast(kind).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = held.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0)).where(~bad)
    most = held.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = most.d if most else 0
    return held.where(F.size("v") == width), width
