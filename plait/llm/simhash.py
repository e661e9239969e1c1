"""SimHash near-dedup by segment-popcount embedding.

A fingerprint's 32 segments of 2 bits become 32 bit counts.  The Manhattan distance of two such points
is at most the Hamming distance of the fingerprints, so fingerprints that link at 2 bits or fewer are
points at distance 2 or less, and two such points always share a lattice cell within one step of both.
Each distinct fingerprint is put in its own cell and in those one step away (65 at most); those that meet
no other there link to nothing and leave.

The rest is verified exactly in cells of the bits themselves (the fingerprint and its 64 one-bit
neighbours), the finest segments there are: two fingerprints share such a cell exactly if they differ in 2
bits or fewer.  Linking each member of a cell to its least member keeps all components and makes no more
rows than members, however many share a cell.  Joins are of one kind at every size, as both sides grow with
the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm.schemas import quoted, restored, slices, whole, with_fields
from plait.plans.components import connected_components
from plait.plans.staging import Scratch

SEED = 42
#: The lower bit of each segment.
LOW = 0x5555555555555555
BLOCK = 1 << 16


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of the words' ``size``-shingles as an unsigned 64-bit integer; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - size + 1)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + size - 1]
        shingles = zip(*(part[k:] for k in range(size))) if len(words) >= size else [words]
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), np.uint64)
        ones += _ones(h)
    return _majority(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of 64-bit ``hashes`` have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of 64-bit hashes as an unsigned integer; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += _ones(hashes[at : at + BLOCK])
    return _majority(ones, len(hashes))


def with_fingerprints(docs: DataFrame, keys: list[str], text: str = "text", size: int = 3) -> DataFrame:
    """The ``keys`` of every row and ``fp``, the fingerprint of its whole text as a signed long."""
    source = docs.select(*map(quoted, keys), quoted(text).cast("string").cast("binary").alias("text"))
    names = [*keys, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(len(keys))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64), pa.int64())], names)

    return source.mapInArrow(run, with_fields(source, keys, fp="long"))


def _signed(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def _cells(prints: DataFrame) -> DataFrame:
    """(cell, fp): the bit counts of the segments of ``fp``, 2 bits each, and the cells one step away."""
    half = F.shiftrightunsigned("fp", 1)
    odd, both = F.col("fp").bitwiseXOR(half).bitwiseAND(_signed(LOW)), F.col("fp").bitwiseAND(half).bitwiseAND(_signed(LOW))
    home, steps = F.col("home"), [F.col("home")]
    for k in range(32):
        none, two = home.bitwiseAND(_signed(3 << 2 * k)) == 0, home.bitwiseAND(_signed(2 << 2 * k)) != 0
        steps += [F.when(~two, home.bitwiseXOR(_signed(1 << 2 * k))), F.when(~none, home.bitwiseXOR(_signed(3 << 2 * k)))]  # 0-1 and 1-2
    counted = prints.select("fp", odd.bitwiseOR(F.shiftleft(both, 1)).alias("home"))
    return counted.select("fp", F.explode(F.array(*steps)).alias("cell")).where("cell is not null")


def _balls(prints: DataFrame) -> DataFrame:
    """(ball, fp): ``fp`` and its 64 one-bit neighbours."""
    near = [F.col("fp").bitwiseXOR(_signed(1 << k)) for k in range(64)]
    return prints.select("fp", F.explode(F.array(F.col("fp"), *near)).alias("ball"))


def links(prints: DataFrame, scratch: Scratch, most: int = 2) -> DataFrame:
    """``prints(fp)``, distinct → edges (a, b) whose components are those of "differ in 2 bits or fewer"."""
    if most != 2:
        raise ValueError("the lattice cells hold for 2 bits")
    cells = _cells(prints)
    shared = scratch.stage(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "cells")
    near = scratch.stage(cells.join(shared.hint("merge"), "cell").select("fp").distinct(), "near")
    balls = _balls(near)
    heads = scratch.stage(balls.groupBy("ball").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"), "heads")
    met = balls.join(heads.hint("merge"), "ball").where("fp != head").select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the least id reachable over fingerprints that link.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows stay; rows with a null
    id get the component's least id that is not null, or null; no rows give no rows.
    """
    rows = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.keep(with_fingerprints(rows, ["id"], "text", size), "prints")
        firsts = scratch.stage(prints.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
        roots = connected_components(links(firsts.select("fp"), scratch), scratch=scratch)
        known = scratch.stage(firsts.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "known")
        heads = scratch.stage(known.groupBy("root").agg(F.min("first").alias("component_id")), "heads")
        by_print = scratch.keep(known.join(heads.hint("merge"), "root").select("fp", "component_id"), "components")
    return prints.join(by_print.hint("merge"), "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Filter: of each component one row stays, that of its least id (of repeated ids one), in the columns of ``docs``.

    Rows with a null id form components like others; one with no id at all keeps a row.  Null and empty texts
    are one component; no rows give no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), quoted(doc_id).alias("id"), quoted(text).alias("text"), whole(docs).alias("rest")), "rows")
        keyed = rows.select(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("d"), F.col("row").alias("r")).alias("key"), "text")
        out = near_duplicates(keyed, "key", "text").where("doc_id = component_id").select(F.col("component_id.r").alias("row"))
        kept = scratch.keep(out, "kept")
    return rows.join(kept, "row").select(*restored(docs))
