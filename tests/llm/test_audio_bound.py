"""Recordings that share a few prints of a short overlap are no candidates; whatever can hold still is."""

import itertools
from collections import Counter

import numpy as np

from plait.llm import audio
from plait.plans.staging import Scratch


def _found(spark, made):
    reps = spark.createDataFrame([(k, p.tolist()) for k, p in made.items()], "row long, prints array<int>").repartition(3)
    with Scratch(spark) as scratch:
        return {tuple(r) for r in audio._candidates(reps, 3, scratch, audio.LONG, audio.TILE).collect()}


def _brute(made):
    """All (x, y, offset) with three votes or more, and whether they hold."""
    out = {}
    for y, x in itertools.combinations(sorted(made), 2):
        a, b = audio.numbered(made[x]), audio.numbered(made[y])
        hist = Counter(p - q for p, v in enumerate(a.tolist()) for q in np.flatnonzero(b == v).tolist())
        out |= {(x, y, o): audio.aligned(made[x], made[y], o, 3) is not None for o, n in hist.items() if n >= 3}
    return out


def test_a_passage_too_short_to_hold(spark):
    rng = np.random.default_rng(1)
    new = lambda n: rng.integers(-(1 << 31), 1 << 31, n).astype(np.int32)
    passage = new(4)
    made = {k: np.concatenate([new(4), passage, new(3)]) for k in range(60)}  # 11 prints, 4 of them in common
    every = _brute(made)
    assert len(every) == 60 * 59 // 2 and not any(every.values())
    assert not _found(spark, made)


def test_what_holds_is_found(spark):
    rng = np.random.default_rng(2)
    new = lambda n: rng.integers(-(1 << 31), 1 << 31, n).astype(np.int32)
    core, made = new(14), {}
    for k in range(90):
        part = core.copy()
        for _ in range(int(rng.integers(0, 10))):  # single wrong bits, so that scores lie around the bound
            part[rng.integers(14)] ^= np.int32(1 << int(rng.integers(31)))
        part = part[int(rng.integers(0, 3)) : 14 - int(rng.integers(0, 3))]
        if k % 3 == 0:  # a steady sound of other lengths before and in it
            part = np.concatenate([np.repeat(part[:1], int(rng.integers(1, 6))), part[:6], np.repeat(part[6:7], int(rng.integers(1, 5))), part[7:]])
        made[k] = np.concatenate([new(int(rng.integers(0, 3))), part])
    every, found = _brute(made), _found(spark, made)
    holds = {k for k, ok in every.items() if ok}
    assert holds <= found <= set(every) and 300 < len(holds) < len(found) < len(every)
