"""Nearest neighbours against all pairs."""

import math
import random
from collections import Counter

import numpy as np

from plait.llm import onebit
from plait.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, asked, k):
    """Rows are (id, vector); a query's own row is one of its id."""
    ok = lambda r: r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    finite = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    width = Counter(len(r[1]) for r in finite).most_common(1)[0][0] if finite else 0
    rows = [r for r in rows if ok(r) and len(r[1]) == width]
    out = []
    for q, v in asked:
        if q is None or not ok((q, v)) or len(v) != width:
            continue
        scores = []
        for i, (c, w) in enumerate(rows):
            total = 0.0
            for a, b in zip(v, w):
                total += a * b
            scores.append((-total, c is None, c or 0, c))
        scores.sort(key=lambda s: s[:3])
        own = next((i for i, s in enumerate(scores) if s[3] == q), None)
        near = [s for i, s in enumerate(scores) if i != own][:k]
        out += [(q, i + 1, s[3], -s[0]) for i, s in enumerate(near)]
    return out


def single(v):
    return [float(np.float32(x)) for x in v]


def made(n, seed, width=16, centres=6, tight=0.3):
    r = random.Random(seed)
    mid = [[r.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(i, single(c + r.gauss(0, tight) for c in r.choice(mid))) for i in range(n)]


def found(spark, rows, asked, k, **more):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    queries = spark.createDataFrame([(*r, 0) for r in asked], SCHEMA)
    return [tuple(r) for r in onebit.search(df, queries, k, **more).collect()]


def recall(got, want):
    got, want = ({r[:3:2] for r in x} for x in (got, want))
    return len(got & want) / len(want)


def test_several_lists_and_shares(spark, monkeypatch):
    for name, value in {"LIST": 100, "SHARE": 90, "QUERIES": 7, "AT_ONCE": 4}.items():
        monkeypatch.setattr(onebit, name, value)
    rows = made(900, 1)
    asked = [r for r in rows if r[0] % 20 == 0]
    assert Counter(found(spark, rows, asked, 5)) == Counter(brute(rows, asked, 5))


def test_copies_ties_and_own_rows(spark, monkeypatch):
    monkeypatch.setattr(onebit, "LIST", 20)
    rows = made(60, 2, width=4)
    # a group of equal vectors larger than k, repeated rows, whole numbers that tie
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [rows[20], rows[20], (None, rows[20][1])]
    rows += [(200 + i, single([i % 2, 1, 0, 0])) for i in range(30)]
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0] + [(None, rows[0][1]), (9999, rows[3][1])]
    assert Counter(found(spark, rows, asked, 6)) == Counter(brute(rows, asked, 6))


def test_unusable_rows_and_few_rows(spark):
    nan, inf = math.nan, math.inf
    bad = [(1, None), (2, []), (3, [None] * 4), (4, [nan] * 4), (5, [inf] * 4), (6, [0.0] * 4), (7, [1.0] * 3)]
    rows = bad + [(20, [1.0, 0.0, 0.0, 0.0]), (21, [2.0**100, 0.0, 0.0, 1.0]), (40, [-1.0, 2.0, 0.0, 0.0])]
    assert Counter(found(spark, rows, rows, 20)) == Counter(brute(rows, rows, 20))
    assert found(spark, bad[:6], bad[:6], 20) == []
    assert found(spark, [], [], 20) == [] and found(spark, rows, [], 20) == []
    assert found(spark, [(20, [1.0, 2.0])], [(20, [1.0, 2.0])], 20) == []


def test_other_names_and_types(spark):
    rows = made(40, 3, width=3)
    df = spark.createDataFrame([(str(i), v, 1, 2) for i, v in rows], "`the.id` string, e array<double>, rank int, score int")
    got = onebit.search(df, df.limit(5), 3, "the.id", "e")
    want = brute([(str(i), v) for i, v in rows], [(r[0], list(r[1])) for r in df.limit(5).collect()], 3)
    # ids that are strings order as strings
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_estimates_within_their_widths():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 64))
    index = onebit.Index(x[:256], 4, 256)
    where, codes, gain, wide, _ = index.encoded(x)
    q = rng.standard_normal((50, 64))
    q /= np.linalg.norm(q, axis=1)[:, None]
    signs = np.unpackbits(codes, axis=1) * 2.0 - 1
    estimate = q @ index.centres[where].T + (q @ index.rotation.T @ signs.T) * gain
    off = (estimate - q @ x.T) / wide
    # without bias, and off by about one width, seldom by four
    assert abs(off.mean()) < 0.05 and 0.8 < off.std() < 1.1 and (np.abs(off) > 4).mean() < 2e-4


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = QUERIES["op13_nearest"](spark, sf).collect()
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want += [(int(ids[q]), r + 1, int(ids[c]), 0.0) for r, c in enumerate(np.lexsort((ids, -s))[:20])]
    assert len(got) == len(want) and recall([tuple(r) for r in got], want) >= 0.999
