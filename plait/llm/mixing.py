"""Mixing sources to target weights.

Sizes are summed by source, targets follow by water-filling over the table of sources, and each document
is emitted floor(rate) times plus once more if a uniform number made from its id and the seed falls below
the fraction.  The source table meets the documents in a plain equi-join: Spark broadcasts it while it is
under the session's threshold and else splits hot sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.schemas import quoted
from plait.plans.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3.0
SEED = "mix"


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``, from 0 by code point and null last; no task sees more than a range of them."""
    order = [F.col("source").isNull(), F.col("source")]
    held = stage(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    before, so_far = [], 0
    for r in sorted(held.groupBy("part").count().collect()):  # a row for each partition of the exchange
        before.append((r.part, so_far))
        so_far += r["count"]
    offsets = F.broadcast(held.sparkSession.createDataFrame(before, "part int, before long"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return held.withColumn("inside", inside).join(offsets, "part").withColumn("rank", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST) -> DataFrame:
    """(source, source_size) → with ``target``: shares of the total by weight, none above ``most`` times its size.

    Sources in order take the weights in turn.  A source of size 0 has target 0.
    """
    table = stage(ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "ranked")
    full = F.col("source_size") * most
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # each round caps at least one source more, or ends
        capped = full < F.col("weight") * level
        held, open_weight = table.agg(F.sum(F.when(capped, full).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        new = (total - held) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.when(full < F.col("weight") * level, full).otherwise(F.col("weight") * level).alias("target"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1 that the id and the seed alone decide."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _with_copies(sized: DataFrame, doc_id: str, weights: tuple[float, ...], most: float, seed: str) -> DataFrame:
    """``sized`` has source, size and the id; adds source_size, target and copies."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stage(targets(sums, weights, most), "targets")
    goal = goal.withColumnRenamed("source", "goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (uniform(F.col(doc_id), seed) < rate - F.floor(rate)).cast("long")
    return sized.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).withColumn("copies", copies).drop("goal_source")


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0),
         most: float = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target (its source's) and copies of every row.

    A null text has size 0; null sources are one source, the last; repeated ids share their draw; no rows give no rows.
    """
    sized = stage(docs.select(quoted(doc_id).alias("doc_id"), quoted(source).cast("string").alias("source"), size_of(quoted(text)).alias("size")), "sizes")
    return _with_copies(sized, "doc_id", weights, most, seed)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0),
        most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mixture itself: every row as often as its copies say, in the columns of ``docs``.

    A null text has size 0 and follows its source's rate like any other; null sources are one source, the last;
    rows of one id share their draw; repeated rows are emitted each; no rows give no rows.
    """
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    sized = docs.select(row.alias("row"), quoted(doc_id).alias("doc_id"), quoted(source).cast("string").alias("source"), size_of(quoted(text)).alias("size"))
    out = _with_copies(sized, "doc_id", weights, most, seed).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
