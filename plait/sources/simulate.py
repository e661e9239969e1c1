"""Seeded simulator of repeat complexes: template, copies that differ at sites, noisy reads with known places.

Randomness is a hash of seed and ids, so that any partitioning gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "acgt"
#: The long-read channel's rates.
SUBSTITUTION, INSERTION, DELETION = 0.014, 0.115, 0.034


def uniform(seed: int, *ids):
    """A number from 0 up to 1 for these ids."""
    return (F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 52)) / float(1 << 52))


def _random_sequence(rng: np.random.Generator, n: int) -> str:
    return "".join(np.array(list(BASES))[rng.integers(0, 4, n)])


def copies(spark: SparkSession, length: int = 5000, n_copies: int = 100, sites: int = 200, seed: int = 1) -> DataFrame:
    """(copy_id, seq): the template with a random subset of its variant sites changed in each copy."""
    rng = np.random.default_rng(seed)
    template = _random_sequence(rng, length)
    where = np.sort(rng.choice(length, min(sites, length), replace=False))
    other = [BASES[(BASES.index(template[p]) + int(s)) % 4] for p, s in zip(where, rng.integers(1, 4, len(where)))]
    share = rng.random(len(where)) * 0.5

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c in pdf["copy_id"]:
                own = np.random.default_rng([seed, 17, int(c)])
                seq = list(template)
                for p, b, hit in zip(where, other, own.random(len(where)) < share):
                    if hit:
                        seq[p] = b
                out.append("".join(seq))
            yield pd.DataFrame({"copy_id": pdf["copy_id"], "seq": out})

    return spark.range(n_copies).withColumnRenamed("id", "copy_id").mapInPandas(make, "copy_id bigint, seq string")


def noisy(seq: str, rng: np.random.Generator, rates: tuple[float, float, float] = (SUBSTITUTION, INSERTION, DELETION)) -> str:
    """The sequence through the error channel."""
    sub, ins, gone = rates
    out = []
    for base in seq:
        while rng.random() < ins:
            out.append(BASES[rng.integers(0, 4)])
        u = rng.random()
        if u < gone:
            continue
        out.append(BASES[(BASES.index(base) + int(rng.integers(1, 4))) % 4] if u < gone + sub else base)
    return "".join(out)


def sampled_lengths(ids: DataFrame, histogram: list[tuple[int, int]], seed: int = 1, key: str = "read_id") -> DataFrame:
    """``ids`` with ``length``, drawn from (length, count) rows by the inverse of their cumulative share."""
    total, so_far, pick = sum(n for _, n in histogram), 0, None
    u = uniform(seed, F.col(key))
    for length, n in sorted(histogram):
        so_far += n
        pick = F.when(u < so_far / total, length) if pick is None else pick.when(u < so_far / total, length)
    return ids.withColumn("length", pick.otherwise(max(x for x, _ in histogram)).cast("int"))


def reads(copies_df: DataFrame, per_copy: int = 50, seed: int = 1, rates: tuple[float, float, float] = (SUBSTITUTION, INSERTION, DELETION)) -> DataFrame:
    """(read_id, copy_id, seq): ``per_copy`` noisy reads of each whole copy."""
    wanted = copies_df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_copy - 1)))).select((F.col("copy_id") * per_copy + F.col("k")).alias("read_id"), "copy_id", "seq")

    def channel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(seq=[noisy(s, np.random.default_rng([seed, 29, int(r)]), rates) for r, s in zip(pdf["read_id"], pdf["seq"])])

    return wanted.mapInPandas(channel, "read_id bigint, copy_id bigint, seq string")


def complex_reads(spark: SparkSession, genome: str, lengths: list[tuple[int, int]], n_reads: int, seed: int = 1, rates: tuple[float, float, float] = (SUBSTITUTION, INSERTION, DELETION)) -> DataFrame:
    """(read_id, start_pos, seq): reads from uniform places of a genome, either strand, cut at its end."""
    shared = spark.sparkContext.broadcast(genome)
    size = len(genome)
    drawn = sampled_lengths(spark.range(n_reads).withColumnRenamed("id", "read_id"), lengths, seed).withColumn("start_pos", F.floor(uniform(seed + 1, F.col("read_id")) * size)).withColumn("flip", uniform(seed + 2, F.col("read_id")) < 0.5)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = str.maketrans("acgt", "tgca")
        for pdf in batches:
            seqs = []
            for r, n, s, flip in zip(pdf["read_id"], pdf["length"], pdf["start_pos"], pdf["flip"]):
                seq = noisy(shared.value[s : s + n], np.random.default_rng([seed, 31, int(r)]), rates)
                seqs.append(seq[::-1].translate(turn) if flip else seq)
            yield pd.DataFrame({"read_id": pdf["read_id"], "start_pos": pdf["start_pos"], "seq": seqs})

    return drawn.mapInPandas(cut, "read_id bigint, start_pos bigint, seq string")
