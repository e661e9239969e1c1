"""InDel detection: windows of columns, a small clustering of each, and rows nearer to a consensus that is not the normal one.

All windows go through one plan: a row is exploded into the windows that it covers, and the clusterings are keyed by
window, or by window and cluster.  Rows of a window that are alike are one text with a number, so a window of few columns
has a bounded number of them, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.functions.bases import hamming
from plait.operators.cluster import member_consensuses, group_clusters
from plait.plans.staging import stage

#: Clusters of more members than this are clustered again within a window.
LARGE = 30


def windows(rows: DataFrame, first: int, last: int, width: int, step: int) -> DataFrame:
    """``rows(sig_id, sig)`` → (window, sig_id, sig): a row's part in each window from ``first`` on in which it is not blank."""
    starts = F.explode(F.sequence(F.lit(first), F.lit(max(first, last - width)), F.lit(step)))
    parts = rows.select(starts.alias("window"), "sig_id", "sig").withColumn("sig", F.substring("sig", F.col("window") + 1, F.lit(width)))
    return parts.where(F.trim("sig") != "")


def window_consensuses(texts: DataFrame, width: int, top: int = 10, least: int = 6) -> DataFrame:
    """``texts(window, sig, n)`` → (window, sig, size): consensuses of ``least`` rows or more after a clustering of each window."""
    keyed = texts.select(F.col("window").cast("string").alias("grp"), "sig", "n")
    tops = keyed.select("grp").distinct().withColumn("top", F.lit(top))
    members, _ = group_clusters(keyed, width, tops, least)
    return _sized(members, width, least)


def cluster_consensuses(parts: DataFrame, members: DataFrame, width: int, least: int = 6, keep: int = 8) -> DataFrame:
    """``windows`` and ``members(cluster_id, sig_id)`` → (window, sig, size): consensuses of each cluster's rows in a window.

    Clusters of ``least`` members or more count; those of over 30 are clustered again within the window, into a
    fifteenth of their number at most.  Consensuses of fewer than ``keep`` rows go.
    """
    sizes = stage(members.groupBy("cluster_id").agg(F.count("*").alias("members")).where(F.col("members") >= least), "sizes")
    grp = F.concat_ws(":", F.col("window").cast("string"), F.col("cluster_id").cast("string")).alias("grp")
    keyed = stage(parts.join(members, "sig_id").join(sizes, "cluster_id").groupBy(grp, "sig", "members").agg(F.count("*").alias("n")), "keyed")
    many = keyed.where(F.col("members") > LARGE)
    tops = many.groupBy("grp").agg(F.floor(F.max("members") / 15).cast("int").alias("top"))
    split, _ = group_clusters(many.select("grp", "sig", "n"), width, tops, least)
    whole = keyed.where(F.col("members") <= LARGE).select("grp", "sig", "n", F.lit(-1).cast("long").alias("cluster_id"))
    return _sized(split.drop("diff").unionByName(whole), width, keep)


def _sized(placed: DataFrame, width: int, keep: int) -> DataFrame:
    placed = stage(placed, "placed")
    sizes = placed.groupBy("grp", "cluster_id").agg(F.sum("n").alias("size")).where(F.col("size") >= keep)
    found = member_consensuses(placed, width).join(sizes, ["grp", "cluster_id"])
    return found.select(F.substring_index("grp", ":", 1).cast("int").alias("window"), "sig", "size")


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points of texts, blanks at their ends."""
    return np.frombuffer("".join(t.ljust(width) for t in texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)


def _nearer(met: DataFrame) -> DataFrame:
    """``met(window, sig, normal, variants)`` → (window, sig) of texts more than one column nearer to a variant than to the normal."""
    def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a[:, None] != b) & (a[:, None] != 32) & (b != 32)).sum(axis=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            near = np.zeros(batch.num_rows, bool)
            window = batch.column(0).to_numpy()
            for w in np.unique(window):
                own = np.flatnonzero(window == w)
                sigs, normal, variants = batch.column(1).take(pa.array(own)).to_pylist(), batch.column(2)[own[0]].as_py(), batch.column(3)[own[0]].as_py()
                width = max(map(len, [*sigs, normal, *variants]))
                a, away = _codes(sigs, width), far(_codes(sigs, width), _codes([normal], width))
                for at in range(0, len(variants), 64):
                    near[own] |= (away > far(a, _codes(variants[at : at + 64], width)) + 1).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["window", "sig"]).filter(pa.array(near))

    return met.select("window", "sig", "normal", "variants").mapInArrow(run, "window int, sig string")


def detect(rows: DataFrame, first: int, last: int, width: int = 200, step: int = 100, least_gaps: int = 0, least: int = 6, top: int = 10, members: DataFrame | None = None) -> DataFrame:
    """``rows(sig_id, sig)`` → (window, sig_id): rows nearer to a variant of their window than to its normal consensus.

    Consensuses are those of a clustering of the window's rows or, with ``members(cluster_id, sig_id)``, of clusters
    that are known already, and those without blanks count.  The normal one is that of most clusters, then of most
    rows, then the last in order.  Every other that differs from it in more than ``width``/200 columns is a variant,
    with more gaps or with fewer; ``least_gaps`` asks for a difference in gaps besides.  A window in which nothing
    varies gives no rows, nor do null or blank signatures.
    """
    parts = stage(windows(rows, first, last, width, step).sortWithinPartitions("window"), "windows")
    kinds = stage(parts.groupBy("window", "sig").agg(F.count("*").alias("n")), "kinds")  # rows of a window that are alike count once
    found = window_consensuses(kinds, width, top, least) if members is None else cluster_consensuses(parts, members, width, least)
    texts = found.where(~F.contains("sig", F.lit(" "))).groupBy("window", "sig").agg(F.count("*").alias("clusters"), F.sum("size").alias("size"))
    # a window has as many consensuses as clusters at most
    listed = texts.groupBy("window").agg(F.sort_array(F.collect_list(F.struct("clusters", "size", "sig")), asc=False).alias("l"))
    listed = listed.select("window", F.col("l")[0]["sig"].alias("normal"), F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: x["sig"]).alias("others"))
    gaps = lambda s: F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit("")))
    differs = lambda s: (hamming(s, F.col("normal")) > width / 200) & (F.abs(gaps(s) - gaps(F.col("normal"))) >= least_gaps)
    variants = listed.select("window", "normal", F.filter("others", differs).alias("variants")).where(F.size("variants") > 0)
    hits = stage(_nearer(kinds.join(stage(variants, "variants"), "window")), "hits")
    return parts.join(hits, ["window", "sig"]).select("window", "sig_id").distinct()
