"""Association scan: which column groups of an alignment co-occur more or less than chance allows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.functions.bases import BASES
from plait.operators.profile import group_sizes
from plait.plans.staging import Scratch

CAP = 99.0
#: Rows and columns of one product.
ROWS, COLUMNS = 4096, 512


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! by Stirling's series at n + 10, less the ten factors that were added."""
    x = n + 10.0
    series = x * np.log(x) - x + 0.5 * np.log(2.0 * np.pi * x) + 1.0 / (12.0 * x) - 1.0 / (360.0 * x**3) + 1.0 / (1260.0 * x**5) - 1.0 / (1680.0 * x**7)
    return series - sum(np.log(n + k) for k in range(1, 11))


def _log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def _tail(k: np.ndarray, a: np.ndarray, b: np.ndarray, cov: np.ndarray, here: np.ndarray, up: bool) -> np.ndarray:
    """P(X >= k), or P(X <= k), from P(X = k): neighbouring terms follow from one another.

    Past the likeliest value terms fall ever faster, so a sum ends where what is left is below its last place: after
    some standard deviations, and not after as many terms as there are rows.
    """
    total, at = here.copy(), np.arange(len(k))
    i, p = k.copy(), here.copy()
    a, b, rest = a, b, cov - a - b
    end = np.minimum(a, b) if up else np.maximum(0.0, -rest)
    while len(at):
        with np.errstate(all="ignore"):
            ratio = (a - i) * (b - i) / ((i + 1) * (rest + i + 1)) if up else i * (rest + i) / ((a - i + 1) * (b - i + 1))
        on = (p > 0) & (i < end if up else i > end) & ((ratio >= 1) | (p * ratio > 1e-18 * (1 - ratio) * total[at])) & (total[at] < 1)
        if not on.all():
            at, i, p, a, b, rest, end, ratio = (x[on] for x in (at, i, p, a, b, rest, end, ratio))
        p = p * ratio
        total[at] += p
        i = i + 1 if up else i - 1
    return np.minimum(total, 1.0)


def _significance(k: np.ndarray, a: np.ndarray, b: np.ndarray, cov: np.ndarray) -> np.ndarray:
    here = np.exp(_log_choose(a, k) + _log_choose(cov - a, b - k) - _log_choose(cov, b))
    lower, upper = _tail(k, a, b, cov, here, False), _tail(k, a, b, cov, here, True)
    p = np.where((k == 0) | (lower < upper), lower, upper)
    return np.where(p <= 0, CAP, np.minimum(CAP, -np.log10(np.maximum(p, 1e-300))))


def hypergeometric_tail(k: Column, a: Column, b: Column, cov: Column) -> Column:
    """-log10 of the smaller of P(X <= k) and P(X >= k) for the overlap of groups of a and b among cov; at most 99.

    k = 0 takes the lower tail.  A tail that underflows is 99.  Null counts give null.
    """
    @F.pandas_udf("double")
    def tail(k: pd.Series, a: pd.Series, b: pd.Series, cov: pd.Series) -> pd.Series:
        known = (k.notna() & a.notna() & b.notna() & cov.notna()).to_numpy()
        out = np.full(len(k), np.nan)
        out[known] = _significance(*(x.to_numpy(dtype=np.float64)[known] for x in (k, a, b, cov)))
        return pd.Series(out).astype(object).where(known, None)

    return tail(*(x.cast("long") for x in (k, a, b, cov)))


def pair_counts(cells: DataFrame, min_distance: int) -> DataFrame:
    """``cells(row_id, col, base)`` → (col1, base1, col2, base2, k): rows that hold both, for columns ``min_distance`` apart or more.

    Rows go through products of one-hot matrices, ``ROWS`` rows and two blocks of ``COLUMNS`` columns at a time, so
    what is shuffled and held has to do with columns and bases, not with rows times columns squared.
    """
    slot = F.instr(F.lit(BASES), F.col("base")) - 1
    rows = cells.groupBy("row_id").agg(F.collect_list(F.struct("col", slot.cast("int").alias("slot"))).alias("c")).select(F.col("c.col").cast("array<int>").alias("col"), F.col("c.slot").alias("slot"))
    kind = cells.schema["col"].dataType.simpleString()

    def multiplied(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [b.column(i) for i in (0, 1) for b in held]
        cols, slots = (np.concatenate([x.flatten().to_numpy() for x in part]) for part in (lists[: len(held)], lists[len(held) :]))
        owner = np.repeat(np.arange(sum(b.num_rows for b in held)), np.concatenate([pa.compute.list_value_length(x).to_numpy() for x in lists[: len(held)]]))
        known, at = np.unique(cols, return_inverse=True)
        def hot(first: int) -> np.ndarray:
            here = (at >= first) & (at < first + COLUMNS)
            out = np.zeros((owner[-1] + 1, 5 * min(COLUMNS, len(known) - first)), np.float32)
            out[owner[here], 5 * (at[here] - first) + slots[here]] = 1
            return out
        for i in range(0, len(known), COLUMNS):
            left = hot(i)
            for j in range(i, len(known), COLUMNS):
                if known[min(j + COLUMNS, len(known)) - 1] < known[i] + min_distance:
                    continue
                k = left.T @ (left if i == j else hot(j))
                a, b = np.nonzero(k)
                far = known[j + b // 5] >= known[i + a // 5] + min_distance
                a, b = a[far], b[far]
                yield pa.RecordBatch.from_arrays([pa.array(known[i + a // 5]), pa.array((a % 5).astype(np.int32)), pa.array(known[j + b // 5]), pa.array((b % 5).astype(np.int32)), pa.array(k[a, b].astype(np.int64))], ["col1", "s1", "col2", "s2", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ROWS:
                yield from multiplied(held)
                held, n = [], 0
        if held:
            yield from multiplied(held)

    made = rows.mapInArrow(run, "col1 int, s1 int, col2 int, s2 int, k long")
    base = lambda c: F.substring(F.lit(BASES), F.col(c) + 1, F.lit(1))
    summed = made.groupBy("col1", "s1", "col2", "s2").agg(F.sum("k").alias("k"))
    return summed.select(F.col("col1").cast(kind).alias("col1"), base("s1").alias("base1"), F.col("col2").cast(kind).alias("col2"), base("s2").alias("base2"), "k")


def overlaps(msa: DataFrame, min_distance: int = 60, min_size: int = 100, min_shared: int = 100, sigmas: float = 7.0, majority: bool = False) -> DataFrame:
    """(col1, base1, col2, base2, k, gr1, gr2, cov) of group pairs that pass the cheap selection.

    One pass counts the rows of all pairs of groups; what two columns share, and a group of one with the other,
    are sums of these.  The selection by standard deviations runs on the sums, so the tail is only worked out for
    what is left.  Blanks and other symbols than ``acgt-`` count nowhere; a row has one cell a column.
    """
    cells = msa.where(F.col("base").isin(*BASES)).select("row_id", "col", "base")
    with Scratch(msa.sparkSession) as scratch:
        sizes = scratch.keep(group_sizes(cells).withColumn("bases", F.sum(F.when(F.col("base") != "-", F.col("n"))).over(Window.partitionBy("col"))), "groups")
        pairs = scratch.keep(pair_counts(cells, min_distance), "pairs")
    largest = sizes.agg(F.max("n").alias("maxcov"))
    fit = sizes.where((F.col("n") > min_size) & (F.col("base") != "-"))
    if majority:
        fit = fit.where(F.col("bases") * 2 > F.col("cov"))
    left = fit.crossJoin(F.broadcast(largest)).where(F.col("cov") * 3 > F.col("maxcov") * 2)  # one row
    # two columns in one row: the 25 counts of their bases, and from them what each of 16 pairs of groups shares
    is_pair = lambda x, y: (F.col("base1") == x) & (F.col("base2") == y)
    counts = [F.sum(F.when(is_pair(x, y), F.col("k")).otherwise(0)).alias(f"k{i}{j}") for i, x in enumerate(BASES) for j, y in enumerate(BASES)]
    wide = pairs.groupBy("col1", "col2").agg(F.sum("k").alias("cov"), *counts).where(F.col("cov") > min_shared)
    total = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    groups = F.array(*[F.struct(F.lit(x).alias("base1"), F.lit(y).alias("base2"), F.col(f"k{i}{j}").alias("k"), total([f"k{i}{n}" for n in range(5)]).alias("gr1"),
                                total([f"k{n}{j}" for n in range(5)]).alias("gr2")) for i, x in enumerate("acgt") for j, y in enumerate("acgt")])
    each = wide.select("col1", "col2", "cov", F.inline(groups)).where("gr1 > 0 and gr2 > 0")
    out = each.join(left.select(F.col("col").alias("col1"), F.col("base").alias("base1"), F.col("n").alias("n1")), ["col1", "base1"]).join(
        fit.select(F.col("col").alias("col2"), F.col("base").alias("base2"), F.col("n").alias("n2")), ["col2", "base2"])
    mean = F.floor(F.col("n1") * F.col("n2") / F.col("cov"))
    return out.where((mean > 0) & (F.abs(F.col("k") - mean) > sigmas * F.sqrt(mean))).select("col1", "base1", "col2", "base2", "k", "gr1", "gr2", "cov")


def scan(msa: DataFrame, **how) -> DataFrame:
    """``overlaps`` with ``z``, the tail of each pair."""
    return overlaps(msa, **how).withColumn("z", hypergeometric_tail(F.col("k"), F.col("gr1"), F.col("gr2"), F.col("cov")))


def column_significance(pairs: DataFrame) -> DataFrame:
    """(col, z): the greatest tail that any group of a column has, cut to a whole number."""
    both = pairs.select(F.col("col1").alias("col"), "z").unionByName(pairs.select(F.col("col2").alias("col"), "z"))
    return both.groupBy("col").agg(F.floor(F.max("z")).alias("z"))


def select_columns(columns: DataFrame, most: int = 300, least: float = 12) -> DataFrame:
    """The ``most`` most significant columns (ties to smaller ones) that reach ``least``, in column order; maybe none."""
    return columns.orderBy(F.desc("z"), "col").limit(most).where(F.col("z") >= least).orderBy("col")


def histogram(values: DataFrame, column: str = "z") -> DataFrame:
    """(bucket, n) of whole parts."""
    return values.groupBy(F.floor(column).alias("bucket")).agg(F.count("*").alias("n"))
