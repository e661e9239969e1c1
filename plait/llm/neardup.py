"""Near copies by the Jaccard similarity of whole sets of word shingles, exactly.

Texts with the same set are one class.  Classes whose SimHash, of the hashes of the set, differs in 2 bits or fewer
are linked by segment-popcount cells (``simhash.links``) and verified on the whole sets first.  As sets of
similarity ``least`` can differ in more bits, an exact way for the rest follows, in which classes of one component need not
meet.

Two sets of similarity ``least`` share one of their first
``n - ceil(least n) + 1`` members in any order that holds for all sets, so classes meet where they share such
a member and are then verified on the whole sets.  The order puts members that are common in a part of the
texts last; which part that is changes the work, never the result.  Of two sets, the one whose first members
end earlier in the order shows all of them that the other has among the other's first members, so its members
that nobody else shows are in no overlap, which bounds the similarity of two classes before they meet.

A member that more than ``crowd`` classes share does not pair them all.  They are verified against a few hubs
first; what is then in one component need not meet, so only classes outside the member's largest component
meet those of other components: a part of these pairs, drawn by a hash, then more, then all that components
still keep apart.

All joins are of one kind at every size, as what they hold grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.llm import simhash
from plait.llm.schemas import quoted, restored, slices, whole, with_fields
from plait.plans.components import connected_components
from plait.plans.staging import Scratch

CROWD, HUBS = 32, 3
HUB = ("row", "n", "i", "free", "last", "root")
#: What part of the pairs outside the largest components is verified in each round; the last takes all that are left.
PARTS = (64, 8, 1)
#: Texts looked at for common shingles, how often these must be seen, and how many of them are told apart.
LOOKED_AT, COMMON, TOLD = 1 << 12, 4, 1 << 16  # a member counts as seen less than 1 << 13 times


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the words' ``size``-shingles; of a shorter text one, of no words none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, out = len(h) - size + 1, np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def first_members(n: int, least: float) -> int:
    """How many members of a set of ``n`` stand for it."""
    return n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """``texts(key, text)`` → ``members``, the whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([shingles(t.as_py(), size).view(np.int64) for t in batch.column(0)], pa.list_(pa.int64()))], ["members"])

    return texts.select(F.col("text").cast("binary")).mapInArrow(run, "members array<long>")


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Members that are common in a part of the texts, ascending, and how often each is seen."""
    every = max(1, texts.count() // LOOKED_AT)
    seen = _sets(texts.where(F.pmod(F.col("key.hash"), F.lit(every)) == 0), size).select(F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    got = sorted((np.uint64(r.m % 2**64), r.n) for r in seen.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "m").limit(TOLD).collect())
    # equal rows have one hash and are looked at together, however many they are
    return np.array([m for m, _ in got], np.uint64), np.array([min(n, 2 * LOOKED_AT - 1) for _, n in got], np.int64)


def _prefixes(texts: DataFrame, size: int, least: float) -> DataFrame:
    """``texts(row, text, ...)`` → its other columns, n, ``digest`` and SimHash ``fp`` of the set, ``prefix``, the members that stand for it, and the place of their last in the order."""
    shared = texts.sparkSession.sparkContext.broadcast(_common(texts, size))
    keys = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in slices(batches):
            n, digest, prints, prefix, last = [], [], [], [], []
            for t in batch.column(len(keys)):
                s = shingles(t.as_py(), size)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                prints.append(simhash.fingerprint_of(s))
                seen = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    seen = np.where(known[at] == s, counts[at], 0)
                first = np.argsort(seen, kind="stable")[: first_members(len(s), least)]
                prefix.append(s[first].view(np.int64))
                last.append((int(seen[first[-1]]) << 50) + (int(s[first[-1]]) >> 14) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)),
                                                    pa.array(prefix, pa.list_(pa.int64())), pa.array(last, pa.int64())], [*keys, "n", "digest", "fp", "prefix", "last"])

    source = texts.select(*keys, F.col("text").cast("binary"))
    return source.mapInArrow(run, with_fields(source, keys, n="int", digest="binary", fp="long", prefix="array<long>", last="long"))


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, least: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Those of ``pairs(a, b)`` that were verified, and those of them whose whole sets are similar; texts travel, as they are smaller than their sets.

    What the first members have in common and all other members of one set bound the overlap; pairs below need no texts.
    """
    ends = pairs.join(classes.select(F.col("row").alias("a"), F.col("n").alias("n1"), F.col("prefix").alias("p1")).hint("merge"), "a").join(
        classes.select(F.col("row").alias("b"), F.col("n").alias("n2"), F.col("prefix").alias("p2")).hint("merge"), "b")
    most = F.size(F.array_intersect("p1", "p2")) + F.greatest(F.col("n1") - F.size("p1"), F.col("n2") - F.size("p2"))
    pairs = scratch.stage(ends.where(most >= least / (1 + least) * (F.col("n1") + F.col("n2")) - 1e-9).select("a", "b"), "likely")
    if pairs.isEmpty():
        return pairs, pairs
    asked = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    asked = classes.select("row", "key").join(asked.hint("merge"), "row")
    some = texts.join(asked.hint("merge"), "key").dropDuplicates(["key"])
    some = scratch.stage(some.select("row", F.col("text").cast("binary").alias("text")), "asked")
    both = pairs.join(some.select(F.col("row").alias("a"), F.col("text").alias("x")).hint("merge"), "a").join(
        some.select(F.col("row").alias("b"), F.col("text").alias("y")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, np.zeros(0, np.uint64)
        for batch in slices(batches):
            out = []
            for b, x, y in zip(*(batch.column(k) for k in (1, 2, 3))):
                if b.as_py() != at:  # pairs come by b
                    at, mine = b.as_py(), shingles(y.as_py(), size)
                other = shingles(x.as_py(), size)
                o = len(np.intersect1d(other, mine, assume_unique=True))
                out.append(o >= least * (len(other) + len(mine) - o) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(out, pa.bool_()))

    return pairs, scratch.stage(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "similar", pairs.count())


def _pairs(own: DataFrame, other: DataFrame, least: float, part: int = 1) -> DataFrame:
    """Pairs (a, b), a < b, of ``own(m, i, row, n, free, last)`` with ``other`` that share a member and can be similar.

    After the member enough others must be left in both, and the one whose first members end earlier must have
    enough members that others show.  Where ``own`` has a ``root``, the other's must differ; of these pairs the
    ``part``-th is made.
    """
    names = {c: f"{c}2" for c in ("i", "row", "n", "free", "last", "root") if c in own.columns}
    met = own.select("m", *names).join(other.select("m", *[F.col(c).alias(d) for c, d in names.items()]).hint("merge"), "m")
    left = F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2"), F.when(F.col("last") < F.col("last2"), F.col("free")).when(F.col("last") > F.col("last2"), F.col("free2")).otherwise(F.greatest("free", "free2")))
    meet = (F.col("root") != F.col("root2")) if "root" in names else (F.col("row") != F.col("row2"))
    if part > 1:
        meet &= F.pmod(F.xxhash64(F.least("row", "row2"), F.greatest("row", "row2")), F.lit(part)) == 0
    met = met.where(meet & (left >= least / (1 + least) * (F.col("n") + F.col("n2")) - 1e-9))
    return met.select(F.least("row", "row2").alias("a"), F.greatest("row", "row2").alias("b")).distinct()


def alike(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``classes(row, fp)`` → pairs (a, b), a < b, whose SimHash differs in 2 bits or fewer: those that hold each print's components together."""
    firsts = scratch.stage(classes.groupBy("fp").agg(F.min("row").alias("first")), "firsts")
    near = simhash.links(firsts.select("fp"), scratch)
    apart = near.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")).hint("merge"), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")).hint("merge"), "b")
    same = classes.select("row", "fp").join(firsts.hint("merge"), "fp").where("row != first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    return same.unionByName(apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def _with_all(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``sums``, an aggregate by ``m``, which is exchanged right below the join (the key is a struct), so that a common ``m`` is split."""
    return rows.withColumn("by", F.struct("m")).join(sums.withColumn("by", F.struct("m")).drop("m").hint("merge"), "by").drop("by")


def _joined(roots: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """``roots(row, root)`` after the components that ``more(a, b)`` links have become one."""
    if more.isEmpty():
        return roots
    stars = roots.select(F.col("row").alias("a"), F.col("root").alias("b"))
    return connected_components(stars.unionByName(more), scratch=scratch).withColumnRenamed("node", "row")


def components(classes: DataFrame, texts: DataFrame, scratch: Scratch, size: int = 5, least: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """``classes(row, key, n, fp, prefix, last)`` and ``texts(key, text)`` → (row, root) of the components of similarity ``least`` or more, without rows that are alone.

    Only what is read more than once is staged, as each staged table costs a file for every partition.
    """
    done, first = _verified(alike(classes, scratch), classes, texts, size, least, scratch)
    roots = connected_components(first, scratch=scratch).withColumnRenamed("node", "row")
    posts = classes.select("row", "n", F.size("prefix").alias("p"), F.posexplode("prefix").alias("i", "m"))
    shared = scratch.stage(_with_all(posts, posts.groupBy("m").agg(F.count("*").alias("held")).where("held > 1")), "shared")
    free = shared.groupBy("row", "n", "p").agg(F.count("*").alias("k")).select("row", (F.col("n") - F.col("p") + F.col("k")).alias("free"))
    bound = free.join(classes.select("row", "last").hint("merge"), "row").join(roots.hint("merge"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    shared = scratch.stage(shared.join(bound.hint("merge"), "row").drop("p"), "bounded")
    calm, full = shared.where(F.col("held") <= crowd), shared.where(F.col("held") > crowd)
    pairs, crowded = _pairs(calm, calm, least), not full.isEmpty()
    if crowded:
        drawn = [F.min(F.struct(F.xxhash64("row", F.lit(k)).alias("o"), *HUB)).alias(f"h{k}") for k in range(HUBS)]
        hubs = full.groupBy("m").agg(*drawn).select("m", F.explode(F.array(*[f"h{k}" for k in range(HUBS)])).alias("h"))
        hubs = hubs.select("m", *[f"h.{f}" for f in HUB]).distinct()
        pairs = pairs.union(_pairs(hubs, full, least)).distinct()
    likely, similar = _verified(pairs, classes, texts, size, least, scratch)
    done, roots = done.unionByName(likely), _joined(roots, similar, scratch)
    for part in PARTS if crowded else ():
        named = full.drop("root").join(roots.hint("merge"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        sizes = named.groupBy("m", "root").agg(F.count("*").alias("k")).groupBy("m").agg(F.max(F.struct("k", "root"))["root"].alias("most"), F.count("*").alias("roots"))
        apart = scratch.stage(_with_all(named, sizes.where("roots > 1").select("m", "most")), "apart")
        more = _pairs(apart.where("root != most"), apart, least, part).join(done.hint("merge"), ["a", "b"], "left_anti")
        likely, similar = _verified(more, classes, texts, size, least, scratch)
        done, roots = done.unionByName(likely), _joined(roots, similar, scratch)
    return roots


def _content(docs: DataFrame) -> Column:
    """A hash of all of a row that can be hashed; maps cannot."""
    return F.xxhash64(*[quoted(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """Filter: of each component of texts with similar sets one row stays, that of its least id (of repeated ids one), in the columns of ``docs``.

    Null texts and texts without words are one class; null ids come last; of rows that are equal in all columns
    one stays; no rows give no rows.  Rows are told apart by id and a 64-bit hash of their columns, so ``docs``
    may be read again in any order.
    """
    key = F.struct(quoted(doc_id).isNull().alias("none"), quoted(doc_id).alias("id"), _content(docs).alias("hash"))
    texts = docs.select(key.alias("key"), quoted(text).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        classes = _prefixes(texts, size, least).groupBy("digest").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("last").alias("last"))
        classes = scratch.stage(classes.select(F.monotonically_increasing_id().alias("row"), "key", "n", "fp", "prefix", "last"), "classes")
        roots = components(classes, texts, scratch, size, least, crowd)
        every = classes.select("row", "key").join(roots.hint("merge"), "row", "left")
        kept = scratch.keep(every.groupBy(F.coalesce("root", "row").alias("root")).agg(F.min("key").alias("key")).select("key"), "kept")
    out = docs.select(key.alias("key"), whole(docs).alias("rest")).join(kept.hint("merge"), "key").dropDuplicates(["key"])
    return out.select(*restored(docs))
