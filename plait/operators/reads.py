"""Ordered lists of typed elements per read: succession, flanks, cuts, islands, adjacency, placements.

Windows are partitioned by read; the few global numberings count by ranges first and add offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.plans.staging import stage


def successions(items: DataFrame, order: list[str]) -> DataFrame:
    """(klass, next, n): how often an element of one class follows one of another in a read."""
    w = Window.partitionBy("read_id").orderBy(*order)
    return items.select("klass", F.lead("klass").over(w).alias("next")).where("next is not null").groupBy("klass", "next").agg(F.count("*").alias("n"))


def gap_histogram(items: DataFrame, pos: str, order: list[str], base: float = 1.5) -> DataFrame:
    """(bucket, n): floors of the logarithms of the distances between neighbours, distances under 1 in bucket -1."""
    w = Window.partitionBy("read_id").orderBy(*order)
    gap = F.lead(pos).over(w) - F.col(pos)
    bucket = F.when(F.col("gap") < 1, -1).otherwise(F.floor(F.ln("gap") / F.ln(F.lit(base)) + 1e-9)).cast("long")
    return items.select(gap.alias("gap")).where("gap is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def order_matrix(hits: DataFrame, length: int, wiggle: int = 150) -> DataFrame:
    """``hits(read_id, pos, part)`` → (part, next, n): how often a hit is followed by one about ``length`` further on.

    Neighbours in order of (pos, part) count where they are less than ``wiggle`` from that distance.
    """
    return _followed(hits).where(F.abs(F.col("pos") + length - F.col("next_pos")) < wiggle).groupBy("part", "next").agg(F.count("*").alias("n"))


def distance_histogram(hits: DataFrame, length: int, base: float = 1.5) -> DataFrame:
    """``hits(read_id, pos, part)`` → (part, next, bucket, n): logarithms, cut off, of 1 + how far neighbours are from ``length`` apart."""
    off = F.abs(F.col("pos") + length - F.col("next_pos"))
    bucket = F.floor(F.ln(1.0 + off) / F.ln(F.lit(base)) + 1e-9).cast("long")
    return _followed(hits).groupBy("part", "next", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _followed(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("read_id").orderBy("pos", "part")
    return hits.select("part", "pos", F.lead("part").over(w).alias("next"), F.lead("pos").over(w).alias("next_pos")).where("next is not null")


def cut_candidates(hits: DataFrame, lengths: DataFrame, parts: int, length: int) -> DataFrame:
    """``hits(read_id, pos, part)``, ``lengths(read_id, size)`` → (read_id, pos), distinct: where the template may end in a read.

    The last part ends there, the first a part's length after it, the last but one before it and the second two
    lengths after it; the place must be more than ``length`` from either end of the read.  One part gives its own ends.
    """
    moves = ((parts - 1, 0), (0, -length), (parts - 2, length), (1, -2 * length)) if parts > 1 else ((0, 0),)
    each = F.filter(F.array(*[F.when(F.col("part") == p, F.lit(d)) for p, d in moves]), lambda x: x.isNotNull())
    moved = hits.select("read_id", "pos", F.explode(each).alias("move")).select("read_id", (F.col("pos") + F.col("move")).alias("pos"))
    inside = moved.join(lengths, "read_id").where((F.col("pos") > length) & (F.col("size") - F.col("pos") > length))
    return inside.select("read_id", "pos").distinct()


def global_number(items: DataFrame, order: list[str], name: str = "number", only: Column | None = None) -> DataFrame:
    """``items`` numbered from 0 over all of them in ``order`` (unique); with ``only``, those that meet it, others null.

    Ranges of the order are counted apart; the offsets are one number a range.
    """
    counts = F.lit(True) if only is None else only
    held = stage(items.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).withColumn("__one", counts.cast("long")), "ranges")
    before, so_far = [], 0
    for r in sorted(held.groupBy("__part").agg(F.sum("__one").alias("n")).collect()):  # a row for each range
        before.append((r["__part"], so_far))
        so_far += r.n
    offsets = F.broadcast(held.sparkSession.createDataFrame(before, "__part int, __before long"))
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = held.withColumn("__n", F.sum("__one").over(w)).join(offsets, "__part")
    return out.withColumn(name, F.when(F.col("__one") == 1, F.col("__before") + F.col("__n") - 1)).drop("__part", "__one", "__n", "__before")


def flanks(items: DataFrame, order: list[str], flank: int, width: int, patterns: dict[str, str] | None = None, signed: bool = False) -> DataFrame:
    """(read_id, *order, klass, ext): each element's signature with ``flank`` characters of either side of its read.

    An element without a signature is its class's pattern over and over; reads are padded with blanks.  ``signed``
    returns elements with a signature only; the others still are in their neighbours' flanks.
    """
    own = F.col("sig")
    if patterns:
        tiles = F.create_map(*[x for k, p in patterns.items() for x in (F.lit(k), F.rpad(F.lit(""), width, F.lit(p)))])
        own = F.coalesce(own, tiles[F.col("klass")])
    own = F.coalesce(own, F.lit(" " * width))
    # flank / width elements either side hold all that is needed
    need = -(-flank // width) if flank else 0
    w = Window.partitionBy("read_id").orderBy(*order)
    left = F.array_join(F.collect_list("own").over(w.rowsBetween(-need, -1)), "") if need else F.lit("")
    right = F.array_join(F.collect_list("own").over(w.rowsBetween(1, need)), "") if need else F.lit("")
    ext = F.concat(F.lpad(F.right(F.col("l"), F.lit(flank)), flank, " "), "own", F.rpad(F.left(F.col("r"), F.lit(flank)), flank, " "))
    out = items.withColumn("own", own).withColumn("l", left).withColumn("r", right)
    out = out.where("sig is not null") if signed else out
    return out.select("read_id", *order, "klass", ext.alias("ext"))


def island_minima(points: DataFrame, order: list[str], cutoff: float) -> DataFrame:
    """(read_id, island, n, best, at): maximal runs below ``cutoff`` and the last place of each one's minimum.

    ``points(read_id, *order, value)``; islands are numbered from 0 within a read; ``at`` is the first of ``order``.
    """
    w = Window.partitionBy("read_id").orderBy(*order)
    below = F.col("value") < cutoff
    starts = below & ~F.coalesce(F.lag(below).over(w), F.lit(False))
    numbered = points.select("*", below.alias("below"), starts.alias("starts")).withColumn("island", F.sum(F.col("starts").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.where("below").groupBy("read_id", "island").agg(F.count("*").alias("n"), F.min("value").alias("best"), F.max_by(order[0], F.struct(-F.col("value"), *order)).alias("at"))


def merge_close(islands: DataFrame, distance: float) -> DataFrame:
    """Of islands nearer than ``distance`` to the last one kept, the better stays: a fold over each read's islands."""
    listed = islands.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("at", "best"))).alias("l"))
    near = lambda acc, x: (F.size(acc) > 0) & (x["at"] - F.element_at(acc, -1)["at"] < distance)
    kept = F.aggregate("l", F.slice("l", 1, 0), lambda acc, x: F.when(near(acc, x), F.when(x["best"] <= F.element_at(acc, -1)["best"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))).otherwise(acc)).otherwise(F.concat(acc, F.array(x))))
    return listed.select("read_id", F.inline(kept))


def cut_chain(hits: DataFrame, size: float) -> DataFrame:
    """(read_id, k, cut): the first hit below 1.5 sizes, then the next over half and under one and a half sizes further.

    ``hits(read_id, pos)``: distinct positions.
    """
    listed = hits.groupBy("read_id").agg(F.array_sort(F.collect_set("pos")).alias("l"))
    fits = lambda acc, x: F.when(F.size(acc) == 0, x < 1.5 * size).otherwise((x - F.element_at(acc, -1) > size / 2) & (x - F.element_at(acc, -1) < 1.5 * size))
    chain = F.aggregate("l", F.slice("l", 1, 0), lambda acc, x: F.when(fits(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return listed.select("read_id", F.posexplode(chain).alias("k", "cut"))


def adjacency(items: DataFrame, hop: int) -> DataFrame:
    """``items(x, y, cluster_id)`` → (c1, c2, weight): how often a cluster is ``hop`` places after another in a read."""
    a, b = items.select("x", "y", F.col("cluster_id").alias("c1")), items.select("x", (F.col("y") - hop).alias("y"), F.col("cluster_id").alias("c2"))
    return a.join(b, ["x", "y"]).groupBy("c1", "c2").agg(F.count("*").alias("weight"))


def with_class(items: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Inner equi-join of elements and their classes; a small class table is broadcast by Spark."""
    return items.join(classes, key)


def override_top(items: DataFrame, members: DataFrame, top: int = 7, klass: str = "klass") -> DataFrame:
    """Elements of the ``top`` largest clusters (``members(cluster_id, seg_id)``; ties to smaller ids) get a class of their own."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster_id").limit(top)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "cluster_id")))  # ``top`` rows
    own = members.join(F.broadcast(ranked), "cluster_id").select("seg_id", F.concat(F.lit("c"), F.col("rank").cast("string")).alias("own"))
    return items.join(own, "seg_id", "left").withColumn(klass, F.coalesce("own", klass)).drop("own")


def anti_reads(items: DataFrame, bad: Column) -> DataFrame:
    """Elements of reads without any element that is ``bad``."""
    return items.join(items.where(bad).select("read_id").distinct(), "read_id", "left_anti")


def first_cut_at_or_after(points: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """``points(*by, pos, ...)`` with ``cut``, the least cut (``cuts(*by, cut)``) at or after its position, or null.

    Cuts and points share one sorted window, so a key's rows are read once and never multiplied.
    """
    names = [c for c in points.columns if c not in by and c != "pos"]
    rows = points.select(*by, "pos", F.struct(*names).alias("rest"), F.lit(None).cast(cuts.schema["cut"].dataType).alias("c"), F.lit(1).alias("kind"))
    marks = cuts.select(*by, F.col("cut").alias("pos"), F.lit(None).cast(rows.schema["rest"].dataType).alias("rest"), F.col("cut").alias("c"), F.lit(0).alias("kind"))
    w = Window.partitionBy(*by).orderBy(F.desc("pos"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(marks).withColumn("cut", F.last("c", ignorenulls=True).over(w))
    return both.where("kind = 1").select(*by, "pos", "cut", "rest.*")


def stable_symbols(rounds: DataFrame, last: int, lag: int = 1) -> DataFrame:
    """``rounds(sig_id, v, round, base)``: the last round's base, or round 0's where it differs from ``lag`` rounds before."""
    at = lambda k: F.max(F.when(F.col("round") == k, F.col("base")))
    return rounds.where(F.col("round").isin(0, last - lag, last)).groupBy("sig_id", "v").agg(_stable(at(0), at(last - lag), at(last)).alias("base"))


def stable_symbols_of(rows: DataFrame, rounds: list[str], lag: int = 1) -> DataFrame:
    """As ``stable_symbols`` where a row of ``rows(sig_id, v, ...)`` holds the bases of all ``rounds``, by round: no row for each, nothing sorted."""
    return rows.select("sig_id", "v", _stable(F.col(rounds[0]), F.col(rounds[-1 - lag]), F.col(rounds[-1])).alias("base"))


def _stable(first: Column, before: Column, last: Column) -> Column:
    return F.when(last == before, last).otherwise(first)


def only_in_one_group(members: DataFrame) -> DataFrame:
    """``members(grp, x, y)`` without elements of several groups."""
    once = members.groupBy("x", "y").agg(F.count_distinct("grp").alias("n")).where("n = 1").drop("n")
    return members.join(once, ["x", "y"], "left_semi")


def group_overlaps(members: DataFrame, reference: DataFrame, share: float = 0.8, least: int = 3) -> DataFrame:
    """(cluster_id, grp, overlap): a cluster's reference groups by overlap until ``share`` of it is met or overlaps fall under ``least``."""
    met = members.join(reference, ["x", "y"]).groupBy("cluster_id", "grp").agg(F.count("*").alias("overlap"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("overlap"), "grp")
    run = met.join(sizes, "cluster_id").withColumn("before", F.coalesce(F.sum("overlap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return run.where((F.col("before") < share * F.col("size")) & (F.col("overlap") >= least)).select("cluster_id", "grp", "overlap")


def best_group(members: DataFrame, reference: DataFrame) -> DataFrame:
    """(cluster_id, grp): the group with most of a cluster's members (ties to the smaller), -1 without any."""
    met = members.join(reference, ["x", "y"], "left").groupBy("cluster_id", "grp").agg(F.count("grp").alias("n"))
    best = met.groupBy("cluster_id").agg(F.max_by("grp", F.struct("n", -F.col("grp"))).alias("grp"))
    return best.select("cluster_id", F.coalesce("grp", F.lit(-1)).alias("grp"))


def groups_above(members: DataFrame, reference: DataFrame, cutoff: int) -> DataFrame:
    """(cluster_id, place, grp, overlap): reference groups that hold more than ``cutoff`` of a cluster's members.

    Places run from 0 by overlap, ties from the greater group; clusters without such a group give no rows.
    """
    met = members.join(reference, ["x", "y"]).groupBy("cluster_id", "grp").agg(F.count("*").alias("overlap")).where(F.col("overlap") > cutoff)
    w = Window.partitionBy("cluster_id").orderBy(F.desc("overlap"), F.desc("grp"))
    return met.select("cluster_id", (F.row_number().over(w) - 1).cast("long").alias("place"), "grp", "overlap")


def concatenate(items: DataFrame, joins: DataFrame) -> DataFrame:
    """``items(read_id, y, ...)`` with elements of other reads after their own: ``joins(read_id, other_id, skip)``.

    A read named in ``joins`` goes on with the other's elements from place ``skip`` on, as both were before any join.
    Reads that are not there change nothing; several joins of one read follow one another by ``other_id``.
    """
    rest = [c for c in items.columns if c not in ("read_id", "y")]
    sizes = items.groupBy("read_id").agg((F.max("y") + 1).alias("size"))
    taken = joins.join(sizes.select(F.col("read_id").alias("other_id"), F.col("size").alias("other_size")), "other_id")
    added = F.greatest(F.lit(0), F.col("other_size") - F.col("skip"))
    before = F.coalesce(F.sum(added).over(Window.partitionBy("read_id").orderBy("other_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = taken.withColumn("before", before).join(sizes, "read_id").select("read_id", "other_id", "skip", (F.col("size") + F.col("before")).alias("at"))
    more = offsets.join(items.withColumnRenamed("read_id", "other_id"), "other_id").where("y >= skip")
    return items.select("read_id", "y", *rest).unionByName(more.select("read_id", (F.col("y") - F.col("skip") + F.col("at")).cast(items.schema["y"].dataType).alias("y"), *rest))


def pad_reads(items: DataFrame, pads: DataFrame) -> DataFrame:
    """``items(read_id, y, klass, ...)`` with elements of a class at either end: ``pads(read_id, before, after, klass)``.

    Places run from 0 again; columns that ``pads`` does not name are null in the new elements.
    """
    rest = [c for c in items.columns if c not in ("read_id", "y", "klass")]
    sizes = items.groupBy("read_id").agg((F.max("y") + 1).alias("size"))
    held = pads.join(sizes, "read_id")
    moved = items.join(pads.select("read_id", "before"), "read_id", "left").withColumn("y", (F.col("y") + F.coalesce("before", F.lit(0))).cast(items.schema["y"].dataType)).drop("before")
    count = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    places = F.concat(count("before"), F.transform(count("after"), lambda k: (k + F.col("before") + F.col("size")).cast("int")))
    new = held.select("read_id", F.explode(places).alias("y"), "klass").withColumn("y", F.col("y").cast(items.schema["y"].dataType))
    for c in rest:
        new = new.withColumn(c, F.lit(None).cast(items.schema[c].dataType))
    return moved.select("read_id", "y", "klass", *rest).unionByName(new)


def membership_columns(sigs: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Signatures with three more columns for each list of ids: ``aaa`` for members, ``ttt`` for others."""
    for name, ids in lists.items():
        flag = ids.select("sig_id").distinct().withColumn(f"__{name}", F.lit(True))
        sigs = sigs.join(flag, "sig_id", "left").withColumn("sig", F.concat("sig", F.when(F.col(f"__{name}"), "aaa").otherwise("ttt"))).drop(f"__{name}")
    return sigs
