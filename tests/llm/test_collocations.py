"""Collocations against counting in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from plait.llm import collocations
from plait.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000):
    out = []
    for lang in {"und" if r[2] is None else r[2] for r in rows}:
        f, n = Counter(), 0
        for _, text, own in rows:
            if (own if own is not None else "und") != lang:
                continue
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
                words = re.findall("[^ \t]+", piece)
                n += len(words)
                f.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        listed = []
        for p, a in found.items():
            if p in inside and 100 * inside[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            listed.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(listed)[:top])]
    return out


def mined(spark, rows, parts=3, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return [tuple(r) for r in collocations.mine(df, **more).collect()]


def prose(n, seed, words=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abéñ") for _ in range(r.randint(1, 4))) for _ in range(words)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(r.randint(0, 60)):
            text.append(r.choice(["New York City", "of the", "red Red", *vocabulary]))
            text.append(r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r\n", " ", "!"]))
        rows.append((i, "".join(text), r.choice(["en", "fr", None, "und", ""])))
    return rows


@pytest.mark.parametrize("least,top", [(30, 2000), (2, 2000), (5, 17)])
def test_equals_counting(spark, least, top):
    rows = prose(150, least)
    got, want = mined(spark, rows, least=least, top=top), brute(rows, least, top)
    assert Counter(got) == Counter(want) and (want or least == 30)


def test_blocks_and_small_chunks(spark, monkeypatch):
    # several blocks of candidates, chunks in the middle of a language, a bitmap that says yes to nearly all
    for name, value in {"BLOCK": 300, "CHUNK": 100, "HELD": 150, "SLICE": 16, "SEEN": 50, "BITS": 18, "RANGE": 64}.items():
        monkeypatch.setattr(collocations, name, value)
    rows = prose(100, 7)
    assert Counter(mined(spark, rows, least=3)) == Counter(brute(rows, 3))


def test_nulls_repeats_and_long_texts(spark):
    rows = [(1, None, "en"), (2, "", "en"), (None, "a b" * 5, None)] + [(3, "x y z w v", "en")] * 40
    rows += [(4, "p q r s t " * 20_000, "fr"), (5, "\x00 \x1c � " * 40, "fr"), (6, "the the the " * 20, "de"), (7, " \t ,.;", "es")]
    assert Counter(mined(spark, rows)) == Counter(brute(rows))


def test_no_rows_and_clashing_names(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, None, None)]) == []
    rows = prose(60, 11)
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "n long, `a.text` string, score string, a int, f int, phrase string, words int")
    got = collocations.mine(df, "a.text", "score", least=3)
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows, 3))


def test_perfect_hash():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    a[:2500] = a[2500:]  # half of the keys share their first 64 bits with another
    known = collocations.PerfectHash(a, b)
    slots = known.slots(a, b)
    assert sorted(slots.tolist()) == list(range(5000))
    assert (known.slots(a, b + np.uint64(1)) == -1).all()
    assert len(collocations.PerfectHash(a[:0], b[:0]).slots(a, b)) == 5000
    with pytest.raises(ValueError):
        collocations.PerfectHash(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op11_collocations"](spark, sf).collect())) == Counter(brute(rows))
