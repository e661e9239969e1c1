"""Unrelated recordings with steady stretches in common stay apart; planted passages are found beside them."""

import numpy as np

from plait.llm import audio
from tests.llm.test_audio import song


def noise(rng, n):
    return rng.integers(0, 256, n).astype(np.uint8).tobytes()


def tone(n, *pitches):
    t = np.arange(n) / audio.RATE
    return (128 + 90 * sum(np.sin(2 * np.pi * p * t) for p in pitches) / len(pitches)).astype(np.uint8).tobytes()


def groups(spark, rows):
    d = spark.createDataFrame(rows, "id long, m binary").repartition(4)
    return {r.id: r.group_id for r in audio.align(d, "id", d.m).collect()}


def test_silence_hum_and_tones_join_nothing(spark):
    rng = np.random.default_rng(11)
    steady = [b"\x80" * 6000, tone(6000, 110), tone(6000, 440), tone(6000, 220, 277, 330)]
    rows, k = [], 0
    for part in steady:
        for make in (noise, song):
            for where in (20_000, 20_000, 20_000, 7_000, 12_345):
                rows.append((k, make(rng, where) + part + make(rng, 40_000 - where)))
                k += 1
    got = groups(spark, rows)
    assert {i: g for i, g in got.items() if g != i} == {}


def test_precision_and_recall(spark):
    rng = np.random.default_rng(12)
    rows, truth = [], {}
    for family in range(12):
        passage = song(rng, 14_000) if family % 2 else noise(rng, 14_000)
        for i in range(4):
            make = noise if i % 2 else song
            before, after = (make(rng, int(n) * audio.HOP) for n in rng.integers(10, 60, 2))
            # a pause that all have, and a little noise over the passage
            heard = np.clip(np.frombuffer(passage, np.uint8).astype(int) + rng.integers(-2, 3, len(passage)), 0, 255).astype(np.uint8).tobytes()
            key = 10 * family + i
            rows.append((key, before + b"\x80" * 4000 + heard + after))
            truth[key] = family
    rows += [(1000 + i, noise(rng, 15_000) + b"\x80" * 6000 + noise(rng, 15_000)) for i in range(20)]
    truth |= {1000 + i: 1000 + i for i in range(20)}
    got = groups(spark, rows)
    pairs = [(i, j) for i in truth for j in truth if i < j]
    found, right = {p for p in pairs if got[p[0]] == got[p[1]]}, {p for p in pairs if truth[p[0]] == truth[p[1]]}
    assert len(found & right) >= 0.9 * len(right) and len(found & right) >= 0.9 * len(found), (len(found), len(right), len(found & right))


def test_unrelated_prints_stay_below_the_score():
    rng = np.random.default_rng(13)
    made = [audio.prints(audio.chroma(make(rng, 30_000))).view(np.int32) for make in (noise, song) for _ in range(6)]
    best = max(audio.stretch(a, b, o)[0] for i, a in enumerate(made) for b in made[:i] for o in range(-90, 91))
    assert best < audio.ENOUGH
