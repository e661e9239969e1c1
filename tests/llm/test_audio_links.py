"""No link is lost where more than two recordings hold a print: all pairs by brute force, prints given."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from plait.llm import audio


def brute_links(made, least_votes=3):
    """Pairs of keys of ``made`` (key → prints, all distinct) that align, and the number of each one's links."""
    links = []
    for i, j in itertools.combinations(sorted(made), 2):
        a, b = audio.numbered(made[j]), audio.numbered(made[i])
        hist = Counter(p - q for p, v in enumerate(a.tolist()) for q in np.flatnonzero(b == v).tolist())
        if any(audio.aligned(made[j], made[i], o, least_votes) for o, n in hist.items() if n >= least_votes):
            links.append((i, j))
    return links, Counter(k for pair in links for k in pair)


def recordings():
    """Prints in which all share values: a passage of many, in wholes, parts and pieces, beside those in common to all at other offsets."""
    rng = np.random.default_rng(8)
    new = lambda n: rng.integers(-(1 << 31), 1 << 31, n).astype(np.int32)
    passage, common, made = new(40), new(30), {}
    for k in range(9):
        made[k] = np.concatenate([new(int(rng.integers(1, 9))), passage[k % 3 * 5 :], new(4), common[rng.permutation(30)]])
    for k in range(9, 16):  # the last half of the passage alone, after values of all
        made[k] = np.concatenate([common[rng.permutation(30)][:20], passage[20:], new(3)])
    for k in range(16, 22):
        made[k] = np.concatenate([common[rng.permutation(30)], passage[rng.permutation(40)], new(5)])
    made[22], made[23] = np.concatenate([new(300), passage]), np.concatenate([new(200), passage, new(90)])
    made[24], made[25] = new(9), np.repeat(new(4), 12)
    return made


@pytest.mark.parametrize("long, tile", [(audio.LONG, audio.TILE), (100, 4), (60, 3)])
def test_every_pair(spark, monkeypatch, long, tile):
    made = recordings()
    links, counts = brute_links(made)
    rows = spark.createDataFrame([(k, p.tolist()) for k, p in made.items()], "key long, prints array<int>")
    monkeypatch.setattr(audio, "with_prints", lambda media, keys, column: rows.repartition(3))
    media = spark.createDataFrame([(k, b"") for k in made], "id long, m binary")
    got = {r.id: r for r in audio.align(media, "id", media.m, long=long, tile=tile).collect()}
    assert {k: r.n_links for k, r in got.items()} == {k: counts[k] for k in made}
    for k, r in got.items():
        assert (r.match_id is None) == (not counts[k]) and (r.match_id is None or tuple(sorted((k, r.match_id))) in links)
    assert counts[5] >= 15 and counts[18] == 0


@pytest.mark.parametrize("pairs", [1, 1 << 20])
def test_agreeing_places(monkeypatch, pairs):
    monkeypatch.setattr(audio, "PAIRS", pairs)
    rng = random.Random(3)
    for need in (1, 2, 3):
        held = [(g, set(rng.sample(range(12), rng.randrange(3, 8)))) for g in range(6) for _ in range(rng.randrange(1, 12))]
        want = {(i, j) for i in range(len(held)) for j in range(i) if held[i][0] == held[j][0] and len(held[i][1] & held[j][1]) == need}
        i, j = audio._agreeing(np.array([g for g, _ in held]), np.array([len(s) for _, s in held]), np.array([x for _, s in held for x in s], np.uint64), need)
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want) > 10
