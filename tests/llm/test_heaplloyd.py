"""Vector codes against plain Lloyd rounds in Python's integers."""

import hashlib
import math
import random
from collections import Counter

import pytest

from plait.llm import heaplloyd
from plait.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(rows, parts=4):
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    lengths = Counter(len(r[1]) for r in rows if len(r[1]) % parts == 0)
    width = max(lengths, key=lambda d: (lengths[d], d), default=None)
    return [r for r in rows if len(r[1]) == width]


def brute(rows, parts=4, entries=256, rounds=4):
    kept = sorted(usable(rows, parts), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    whole = [[int(x) * 1024 if abs(x) > 2**60 else math.floor(1024 * x) for x in r[1]] for r in kept]
    d = len(whole[0]) // parts
    cut = [[v[p * d : (p + 1) * d] for v in whole] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut[p]:
                groups.setdefault(nearest(x, books[p])[1], []).append(x)
            books[p] = [[sum(col) // len(groups[e]) for col in zip(*groups[e])] if e in groups else c for e, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(kept))]
    errors = [min(sum(f[0] for f in fs), (1 << 63) - 1) for fs in found]
    by = Counter()
    for r, e in zip(kept, errors):
        by[r[2]] += e
    return [(r[0], "".join(f"{f[1]:02x}" for f in fs), e, min(by[r[2]], (1 << 63) - 1), digest) for r, fs, e in zip(kept, found, errors)]


def coded(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return [tuple(r) for r in heaplloyd.compress(df, **more).drop("label").collect()]


def spread(n, seed, width=8, grid=4):
    r = random.Random(seed)
    return [(i, [r.randint(-grid, grid) / grid for _ in range(width)], r.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("entries,chunk,rounds", [(16, 50, 4), (7, 8192, 6), (1, 40, 2)])
def test_equals_lloyd(spark, monkeypatch, entries, chunk, rounds):
    # many ties: components lie on a coarse grid; several chunks a partition
    monkeypatch.setattr(heaplloyd, "CHUNK", chunk)
    rows = spread(400, entries)
    assert Counter(coded(spark, rows, entries=entries, rounds=rounds)) == Counter(brute(rows, entries=entries, rounds=rounds))


def test_nulls_repeats_lengths_and_huge_numbers(spark):
    rows = spread(60, 5)
    rows += [(None, rows[3][1], None), (7, rows[7][1], 1), (7, rows[7][1], 1), (8, rows[9][1], 2)]
    rows += [(100, None, 1), (101, [], 1), (102, [None] * 8, 1), (103, [math.nan] * 8, 1), (104, [math.inf] * 8, 1), (105, [1.0] * 4, 1), (106, [1.0] * 6, 2)]
    assert Counter(coded(spark, rows, entries=16)) == Counter(brute(rows, entries=16))
    rows += [(200, [2.0**127] * 8, 1), (201, [-(2.0**127)] + [0.5] * 7, 2), (202, [2.0**40] * 8, None), (203, [1e5] * 8, 1)]
    assert Counter(coded(spark, rows, entries=80)) == Counter(brute(rows, entries=80))


def test_no_rows(spark):
    out = heaplloyd.compress(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert coded(spark, [(1, None, 1)]) == []


def test_other_names_and_more_columns(spark):
    rows = spread(30, 9)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "`a.id` long, e array<float>, code int, label string, error int")
    got = heaplloyd.compress(df, "a.id", "e", "code", entries=8).drop("label")
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows, entries=8))


def test_only_violated_parts_are_scanned_again(spark, monkeypatch):
    # far groups, one of which moves: the heaps of the others stay closed
    import numpy as np

    x = np.array([[k * 1000 + j] for k in range(4) for j in range(10)], np.int16)
    books = heaplloyd.Books(np.array([[[0], [1000], [2000], [3000]]], object), np.zeros((1, 4)))
    heaps, _ = heaplloyd._first(x, books, float)
    books = books.moved_to(np.array([[[4], [1000], [2000], [3000]]], object))
    seen = []
    monkeypatch.setattr(heaplloyd, "_scan", lambda x, *a, f=heaplloyd._scan: (seen.append(len(x)), f(x, *a))[1])
    heaplloyd._later(x, heaps, books, float)
    assert seen == [0]
    books = books.moved_to(np.array([[[990], [1000], [2000], [3000]]], object))
    heaps, sums = heaplloyd._later(x, heaps, books, float)
    assert 0 < seen[-1] < len(x)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op12_vector_codes"](spark, sf).collect())) == Counter(brute(rows))
