"""Column profiles, sum-of-pairs scores and the row structure of alignments.

An alignment in long form is (row_id, col, base), blanks included or left out alike; wide form is (row_id, row).
Everything here aggregates by column or row with map-side partials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.functions.bases import BASES, code, symbols


def to_long(rows: DataFrame, row_id: str = "row_id", row: str = "row") -> DataFrame:
    """Wide to long, blanks left out."""
    return rows.select(F.col(row_id).alias("row_id"), F.posexplode(symbols(F.col(row))).alias("col", "base")).where("base != ' '")


def to_wide(msa: DataFrame, width: int) -> DataFrame:
    """Long to wide: (row_id, row) of ``width`` characters, blank where nothing is."""
    cells = msa.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "base"))).alias("cells"))
    return cells.select("row_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.coalesce(F.element_at("cells", c), F.lit(" "))), "").alias("row"))


def column_profile(msa: DataFrame) -> DataFrame:
    """(col, base, n) of what is not blank."""
    return msa.where("base != ' '").groupBy("col", "base").agg(F.count("*").alias("n"))


def weighted_costs(msa: DataFrame) -> DataFrame:
    """(col, base, cost) for each base and the gap: coverage less the base's count."""
    wide = msa.where("base != ' '").groupBy("col").agg(F.count("*").alias("cov"), *[F.count_if(F.col("base") == b).alias(f"n{i}") for i, b in enumerate(BASES)])
    entries = F.array(*[F.struct(F.lit(b).alias("base"), (F.col("cov") - F.col(f"n{i}")).alias("cost")) for i, b in enumerate(BASES)])
    return wide.select("col", F.inline(entries))


def row_scores(msa: DataFrame) -> DataFrame:
    """(row_id, score): the sum over a row's cells of the column's cost of its base."""
    return msa.join(weighted_costs(msa), ["col", "base"]).groupBy("row_id").agg(F.sum("cost").alias("score"))


def sum_of_pairs(msa: DataFrame) -> DataFrame:
    """One row: score, the sum over columns and bases of n (coverage - n)."""
    by_col = column_profile(msa).groupBy("col").agg(F.sum("n").alias("cov"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return by_col.agg(F.coalesce(F.sum(F.col("cov") * F.col("cov") - F.col("same")), F.lit(0)).alias("score"))


def alignment_quality(msa: DataFrame) -> DataFrame:
    """One row: quality, the mismatches seen from bases per base compared with a column's coverage; null without bases."""
    wide = msa.where("base != ' '").groupBy("col").agg(F.count("*").alias("cov"), F.count_if(F.col("base") == "-").alias("gaps"))
    same = column_profile(msa).where("base != '-'").groupBy("col").agg(F.sum(F.col("n") * F.col("n")).alias("same"))
    bases = F.col("cov") - F.col("gaps")
    return wide.join(same, "col", "left").agg((F.sum(bases * F.col("cov") - F.coalesce("same", F.lit(0))).cast("double") / F.sum(bases * F.col("cov"))).alias("quality"))


def group_sizes(msa: DataFrame) -> DataFrame:
    """(col, base, n, cov): members of each column group and the column's coverage."""
    by_base = column_profile(msa)
    return by_base.join(by_base.groupBy("col").agg(F.sum("n").alias("cov")), "col")


def blank_terminal_gaps(msa: DataFrame) -> DataFrame:
    """Gaps before a row's first base and after its last leave; columns without any base leave with them."""
    ends = msa.where("base not in ('-', ' ')").groupBy("row_id").agg(F.min("col").alias("first"), F.max("col").alias("last"))
    inner = msa.join(ends, "row_id").where("col between first and last and base != ' '").select("row_id", "col", "base")
    return inner.join(inner.where("base != '-'").select("col").distinct(), "col", "left_semi")


def base_paths(msa: DataFrame) -> DataFrame:
    """(row_id, ordinal, col): the column of a row's n-th base, from 0."""
    order = Window.partitionBy("row_id").orderBy("col")
    return msa.where("base not in ('-', ' ')").select("row_id", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), "col")


def insertion_runs(msa: DataFrame) -> DataFrame:
    """(row_id, start, len): maximal runs of gaps inside a row."""
    order = Window.partitionBy("row_id").orderBy("col")
    gaps = msa.where("base = '-'").withColumn("island", F.col("col") - F.row_number().over(order))
    return gaps.groupBy("row_id", "island").agg(F.min("col").alias("start"), F.count("*").alias("len")).drop("island")


def widest_insertions(runs: DataFrame) -> DataFrame:
    """(start, width): the widest run that starts at a column."""
    return runs.groupBy("start").agg(F.max("len").alias("width"))


def sliding_windows(msa: DataFrame, width: int, step: int) -> DataFrame:
    """(window, col, base, n): profiles of windows of ``width`` columns every ``step`` columns."""
    first = F.greatest(F.lit(0), F.ceil((F.col("col") - width + 1) / step)).cast("int")
    placed = column_profile(msa).withColumn("window", F.explode(F.sequence(first, F.floor(F.col("col") / step).cast("int"))))
    return placed.select("window", "col", "base", "n")


def project_columns(msa: DataFrame, chosen: DataFrame) -> DataFrame:
    """The alignment's cells in the ``chosen(col)`` columns, renumbered in their order."""
    kept = msa.join(chosen.select("col").distinct(), "col", "left_semi")
    order = Window.orderBy("col")
    rank = chosen.select("col").distinct().withColumn("v", (F.row_number().over(order) - 1).cast("int"))  # columns, not rows: few
    return kept.join(rank, "col").select("row_id", F.col("v").alias("col"), "base")


def coded(msa: DataFrame) -> DataFrame:
    return msa.withColumn("code", code(F.col("base")))
