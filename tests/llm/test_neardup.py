import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline
from plait.llm import neardup


def brute_kept(rows):
    """Ids left of (id, text) rows with distinct ids, by all pairs."""
    def five(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets, root = [five(t) for _, t in rows], list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        o = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 10 * o >= 8 * (len(sets[i]) + len(sets[j]) - o) and o:
            a, b = find(i), find(j)
            root[b] = a
    return sorted(min(rows[k][0] for k in range(len(rows)) if find(k) == r) for r in {find(k) for k in range(len(rows))})


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.random()}"
    return out


def made():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, passage = [], [word() for _ in range(50)]
    for _ in range(12):  # chains of copies, similar to one another or just not
        base = [word() for _ in range(rng.choice([3, 5, 9, 40, 150]))]
        for n in (0, 0, 1, 2, 3, 4, 5):
            base = edited(rng, base, n)
            rows.append(" ".join(base))
    for n in (20, 60, 200):  # a passage that many texts share
        rows += [" ".join([word() for _ in range(n // 2)] + passage + [word() for _ in range(n // 2)]) for _ in range(12)]
    base = [word() for _ in range(120)]  # a large group of near copies of one text, with some that are just not
    rows += [" ".join(edited(rng, base, rng.choice([1, 1, 2, 6]))) for _ in range(60)]
    rows += ["", None, " \n ", "One", "one"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_all_pairs(spark, docs):
    rows = made()
    want, d = brute_kept(rows), docs(rows)
    for crowd in (1, 8, 10_000):
        assert sorted(r.doc_id for r in neardup.keep_one(d, crowd=crowd).collect()) == want, crowd
    assert 60 < len(want) < len(rows) - 60


def test_pipeline_stage_takes_five_words_at_four_fifths(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_kept([(r.doc_id, r.text) for r in d.collect()])
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, d, "").collect())
    assert got == want and {145, 177}.isdisjoint(got)


def test_ids(docs):
    d = docs([(5, "a b c d e"), (3, "A b c d e"), (3, "a b c d e"), (9, "something else is here"), (None, "nothing else like this one"), (None, None), (4, "")]).selectExpr("*", "'x' as `key`", "1 as row", "2 as `a.b`")
    kept = neardup.keep_one(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 4), (False, 9), (True, 0)]
    assert neardup.keep_one(docs([])).count() == 0


def test_clashing_names_and_long_texts(spark):
    rng = random.Random(5)
    long = " ".join(str(rng.random()) for _ in range(60_000))
    rows = [(1, long, 5, "p"), (2, long + " more", 6, "q"), (3, "other words are here now", 7, "r"), (3, "other words are here now", 7, "r"), (3, "not the same words at all", 8, "s")]
    d = spark.createDataFrame(rows, "key long, row string, __row int, rest string")
    kept = neardup.keep_one(d, "key", "row")
    assert kept.columns == d.columns and sorted(tuple(r)[:1] + tuple(r)[2:] for r in kept.collect()) == [(1, 5, "p"), (3, 7, "r"), (3, 8, "s")]


def test_equal_rows_beyond_the_texts_looked_at(spark):
    key = F.struct(F.lit(False).alias("none"), F.lit(1).alias("id"), F.lit(0).cast("long").alias("hash"))
    texts = spark.range(9000).select(key.alias("key"), F.lit("one two three four five six").alias("text"))
    got = neardup._prefixes(texts, 5, 0.8).select("n", F.size("prefix").alias("p"), "last").distinct().collect()
    assert len(got) == 1 and (got[0].n, got[0].p) == (2, 1) and got[0].last > 0
