import itertools
from collections import Counter

import numpy as np

from plait.llm import audio


def all_pairs(rows, least_votes=3):
    """Prints and class of each key, and every pair of classes that aligns: all offsets with the votes, all stretches."""
    made = {k: audio.prints(audio.chroma(m)) for k, m in rows}
    reps = {}
    for k in sorted(made):
        reps.setdefault(made[k].tobytes(), k)
    links = {}
    for i, j in itertools.combinations(sorted(reps.values()), 2):
        a, b = made[j].tolist(), made[i].tolist()
        places = {}
        for q, v in enumerate(b):
            places.setdefault(v, []).append(q)
        hist = Counter(p - q for p, v in enumerate(a) for q in places.get(v, ()))
        best = (0, 0)
        for off in (o for o, n in hist.items() if n >= least_votes):
            score = [8 - (a[p] ^ b[p - off]).bit_count() for p in range(max(0, off), min(len(a), len(b) + off))]
            for s in range(len(score)):
                total = 0
                for e in range(s, len(score)):
                    total += score[e]
                    best = max(best, (total, e - s + 1))
        if best[1] >= least_votes:
            links[i, j] = best
    return made, {k: reps[made[k].tobytes()] for k in made}, links


def test_integral_image_filters():
    rng = np.random.default_rng(0)
    image = rng.random((40, 12)).astype(np.float32)
    got = audio.prints(image)
    for t in (0, 7, len(got) - 1):
        want = 0
        for kind, y, high, wide in audio._filters():
            s = lambda a, b, c, d: image[t + a : t + b, c : d].sum(dtype=float)
            whole = s(0, wide, y, y + high)
            part = [whole, s(0, wide, y, y + high // 2), s(0, wide // 2, y, y + high), s(0, wide // 2, y, y + high // 2) + s(wide // 2, wide, y + high // 2, y + high)][kind]
            rest = s(0, wide, 0, 12) - part if kind == 0 else whole - part
            value = np.log((0.01 + part) / (0.01 + rest))
            level = int(value > -audio.STEP) + int(value > 0) + int(value > audio.STEP)
            want = want << 2 | (level ^ level >> 1)
        assert int(got[t]) == want


def song(rng, n):
    return (128 + 100 * np.sin(np.cumsum(rng.random(n // 400 + 1).repeat(400)[:n]))).astype(np.uint8).tobytes()


def test_semitones_of_four_octaves():
    t = np.arange(16000) / audio.RATE
    for k in range(48):
        tone = (128 + 100 * np.sin(2 * np.pi * 110 * 2 ** (k / 12) * t)).astype(np.uint8).tobytes()
        got = audio.chroma(tone)[8:-8]
        assert set(got.argmax(axis=1).tolist()) == {k % 12}, k


def test_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    core, hop = song(rng, 24000), audio.HOP
    pieces = [core[k : k + 40 * hop] for k in range(0, 24000 - 40 * hop, 40 * hop)]
    rows = [(0, b"".join(pieces[k] for k in rng.permutation(len(pieces))))]  # a hub that holds the core in pieces
    rows += [(1, song(rng, 4 * hop) + core), (2, core[: 70 * hop] + song(rng, 9000)), (3, song(rng, 20 * hop) + core[20 * hop :])]
    for base in range(10, 50, 10):  # families that share a passage within other material
        passage = song(rng, 40 * hop)
        for i in range(5):
            rows.append((base + i, song(rng, int(rng.integers(3, 30)) * hop) + passage + song(rng, int(rng.integers(3, 30)) * hop)))
    own = song(rng, 30 * hop)
    noisy = bytes(int(min(255, max(0, x + rng.integers(-2, 3)))) for x in own)
    rows += [(50, own), (51, noisy), (52, own), (53, song(rng, 50 * hop)), (54, b""), (55, None), (56, b"x"), (57, b"\x80" * 5000), (58, b"\x80" * 9000)]
    made, classes, links = all_pairs([r for r in rows])
    d = spark.createDataFrame(rows, "id long, media binary").selectExpr("*", "1 as prints", "2 as key", "3 as rep").withColumnRenamed("media", "m")
    got = {r.id: r for r in audio.align(d, "id", d.m).collect()}
    assert {k: (r.n_prints, r.class_id) for k, r in got.items()} == {k: (len(made[k]), classes[k]) for k in made}
    together = sum(got[i].group_id == got[j].group_id for i, j in links)
    assert len(links) > 45 and together >= 0.9 * len(links), (together, len(links))
    assert got[1].group_id == got[2].group_id == got[3].group_id and 2 in (got[1].match_id, got[3].match_id) or got[2].match_id in (1, 3)
    for k, r in got.items():  # what is reported holds, and both ends know of it
        assert (r.match_id is None) == (r.n_links == 0)
        if r.match_id is not None and k == r.class_id:
            assert tuple(sorted((k, r.match_id))) in links and got[r.match_id].n_links > 0
            assert r.overlap >= 3 and r.bit_errors <= 8 * r.overlap
    assert got[0].n_links > 0 and got[52].class_id == 50 and {got[k].n_links for k in (53, 54, 55, 56)} == {0}
    assert audio.align(d.limit(0), "id", d.m).count() == 0
    twice = audio.align(d.where("id in (50, 53)").unionByName(d.where("id = 50").selectExpr("cast(null as long) id", "m", "prints", "key", "rep")), "id", d.m).collect()
    assert sorted((str(r.id), r.class_id) for r in twice) == [("50", 50), ("53", 53), ("None", 50)]


def test_the_best_stretch():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 32, 60, dtype=np.uint32).view(np.int32) for _ in range(2))
    b[10:30] = a[15:35]
    assert audio.stretch(a, b, 5)[1:] == (20, 0) and audio.stretch(a, b, 100) == (0, 0, 0)


def test_a_value_that_all_hold_and_a_long_recording(spark):
    rng = np.random.default_rng(7)
    silence, theme = b"\x80" * 6000, song(rng, 12000)
    rows = [(i, silence + song(rng, 4000)) for i in range(30)] + [(40, theme + silence), (41, silence + theme), (42, song(rng, 1_500_000) + theme)]
    d = spark.createDataFrame(rows, "id long, m binary")
    got = {r.id: r for r in audio.align(d.repartition(9), "id", d.m).collect()}
    assert {r.group_id for r in got.values()} == {0} and got[42].n_links > 0
