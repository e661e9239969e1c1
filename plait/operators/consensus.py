"""Consensus of groups of signatures, in the dialects that differ in ties, thin coverage and doubt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.functions.bases import BASES


def counts(cells: DataFrame, by: list[str] = ["grp"]) -> DataFrame:  # noqa: B006
    """``cells(*by, col, base)`` → (*by, col, base, n) of what is not blank; a cell with a ``weight`` is so many."""
    n = F.sum("weight") if "weight" in cells.columns else F.count("*")
    return cells.where("base != ' '").groupBy(*by, "col", "base").agg(n.alias("n"))


def ranked(cells: DataFrame, by: list[str] = ["grp"]) -> DataFrame:  # noqa: B006
    """(*by, col, base, n, cov, top, second): the commonest base, ties in the order ``acgt-``, and how clear it is."""
    slot = F.instr(F.lit(BASES), F.col("base"))
    listed = counts(cells, by).groupBy(*by, "col").agg(F.sum("n").alias("cov"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), slot.alias("slot"), "base"))).alias("l"))
    return listed.select(*by, "col", F.col("l")[0]["base"].alias("base"), "cov", (-F.col("l")[0]["m"]).alias("top"), F.when(F.size("l") > 1, -F.get("l", F.lit(1))["m"]).otherwise(0).alias("second"))


def consensus(cells: DataFrame, width: int, dialect: str = "argmax", empty: str = " ", by: list[str] = ["grp"]) -> DataFrame:  # noqa: B006
    """(*by, consensus) of ``width`` characters; uncovered columns are ``empty``.

    ``argmax``: the commonest base, ties in the order ``acgt-``.  ``last``: ties in the opposite order.
    ``strict``: ``x`` unless coverage is over 10 and the commonest over twice the second.
    """
    if dialect == "last":
        slot = F.instr(F.lit(BASES), F.col("base"))
        chosen = counts(cells, by).groupBy(*by, "col").agg(F.max_by("base", F.struct("n", slot)).alias("base"))
    else:
        chosen = ranked(cells, by)
        if dialect == "strict":
            chosen = chosen.withColumn("base", F.when((F.col("cov") > 10) & (F.col("top") > 2 * F.col("second")), F.col("base")).otherwise("x"))
            empty = "x"
    cells_of = chosen.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("col", "base"))).alias("cells"))
    string = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.coalesce(F.element_at("cells", c), F.lit(empty))), "")
    return cells_of.select(*by, string.alias("consensus"))


def support(cells: DataFrame, by: list[str] = ["grp"]) -> DataFrame:  # noqa: B006
    """(*by, first, total): cells that agree with their column's commonest base, and all cells."""
    return ranked(cells, by).groupBy(*by).agg(F.sum("top").alias("first"), F.sum("cov").alias("total"))


def split_columns(cells: DataFrame, ratio: float = 1.5) -> DataFrame:
    """(grp, col, top, second): columns whose commonest base is under ``ratio`` times the second."""
    return ranked(cells).where((F.col("second") > 0) & (F.col("top") < ratio * F.col("second"))).select("grp", "col", "top", "second")


def ambiguous_columns(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(grp, col): columns covered by over half of the group (``sizes(grp, size)``) with two bases over least(size/5, 15)."""
    least = F.least(F.floor(F.col("size") / 5), F.lit(15))
    per = counts(cells).join(sizes, "grp").groupBy("grp", "col", "size").agg(F.sum("n").alias("cov"), F.count_if((F.col("n") > least) & (F.col("base") != "-")).alias("k"))
    return per.where((F.col("k") >= 2) & (F.col("cov") > F.col("size") / 2)).select("grp", "col")


def percent_fit(fit, coverage):
    """Percent with two decimals, cut off."""
    return F.when(coverage > 0, F.floor(fit * 10000 / coverage) / 100)


def typical_coverage(sizes: DataFrame) -> DataFrame:
    """One row: typical, the commonest triple of sizes within the commonest decile of tens (smaller ones win ties)."""
    tens = sizes.groupBy(F.floor(F.col("size") / 10).alias("ten")).agg(F.count("*").alias("n")).agg(F.max_by("ten", F.struct("n", -F.col("ten"))).alias("ten"))
    inside = sizes.join(F.broadcast(tens), F.floor(F.col("size") / 10) == F.col("ten"))  # one row
    triples = inside.groupBy(F.floor(F.col("size") / 3).alias("three")).agg(F.count("*").alias("n"))
    return triples.agg((F.max_by("three", F.struct("n", -F.col("three"))) * 3).alias("typical"))
