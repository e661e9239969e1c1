import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from plait.llm import langid


def brute(rows, bits):
    """Naive Bayes over the same hashed n-grams, one character at a time."""
    def grams(text):
        low, out = text.lower(), []
        c = [ord(x) if x.isalpha() else 0 for x in low]
        m = (1 << 64) - 1
        def bucket(v):
            v ^= v >> 29
            return (v * 0xBF58476D1CE4E5B9 & m) >> (64 - bits)
        for i, x in enumerate(c):
            if not x:
                continue
            before, after = c[i - 1] if i else 0, c[i + 1] if i + 1 < len(c) else 0
            out.append(bucket(x * 0x9E3779B97F4A7C15 & m))
            if after:
                out.append(bucket((x * 0xC2B2AE3D27D4EB4F & m) ^ (after * 0x165667B19E3779F9 & m)))
            out.append(bucket((before * 0xD6E8FEB86659FD93 & m) ^ (x * 0xA0761D6478BD642F & m) ^ (after * 0xE7037ED1A0B428DB & m)))
        return out
    counts, n = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            counts[lang].update(grams(text))
            n[lang] += 1
    langs = sorted(n)
    total = {g: sum(counts[g].values()) + 0.5 * 2**bits for g in langs}
    out = {}
    for i, text, _ in rows:
        f = grams(text or "")
        if not f or not langs:
            out[i] = ("und", 0.0)
            continue
        s = [math.log(n[g] / sum(n.values())) + sum(math.log((counts[g][b] + 0.5) / total[g]) for b in f) for g in langs]
        p = [math.exp(x - max(s)) for x in s]
        out[i] = (langs[int(np.argmax(s))], max(p) / sum(p))
    return out


def test_matches_brute_force(spark, docs):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("le chat et l'éléphant", "fr"), ("der Hund läuft", "de"),
            ("", "en"), (None, "fr"), ("123 !!", "de"), ("Été \U0001d4d0 İx", "fr"), ("the the the", None), ("x" * 5000, "xx")] * 6)]
    d = docs(rows)
    model = langid.train(d.where(~langid.held_out()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(d, model).collect()}
    want = brute(rows, langid.BUCKET_BITS)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-3 for k in want)


def test_long_texts_in_pieces(monkeypatch):
    texts = ["ab cd éa" * 50, None, "", "zz"]
    def total(piece):
        monkeypatch.setattr(langid, "PIECE", piece)
        out = Counter()
        for rows, buckets in langid.grams(texts):
            out.update(zip(rows.tolist(), buckets.tolist()))
        return out
    assert total(7) == total(1 << 18)


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(d.where(~langid.held_out()))
    held = langid.predict(d.where(langid.held_out()), model).where("lang is not null and lang_pred != 'und'")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count() > 0


def test_empty_nulls_and_clashing_columns(spark, docs):
    empty = docs([])
    model = langid.train(empty)
    assert langid.predict(empty, model).count() == 0
    d = docs([(None, "abc", None), (1, None, None), (1, None, None)]).selectExpr("*", "'x' as lang_pred", "1 as `a.b`")
    got = langid.predict(d, model).collect()
    assert [r.lang_pred for r in got] == ["und"] * 3 and got[0]["a.b"] == 1
    assert langid.keep_known(docs([(1, "1 2 3", "en"), (2, "hello there", "en"), (3, "hello you", "en")] * 3)).select("doc_id").distinct().count() == 2


def test_keep_known_with_clashing_names(spark):
    rows = [(i, "the cat sat on the mat and the dog" if i % 2 else "der hund und die katze sind hier", "en" if i % 2 else "de", i, "p", "q") for i in range(40)] + [(99, None, None, 7, "p", "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, __lang_pred int, lang_pred string, whole string")
    got = langid.keep_known(d)
    assert got.columns == d.columns and sorted(map(tuple, got.collect())) == sorted(rows[:-1])
    assert langid.keep_known(d.limit(0)).count() == 0
