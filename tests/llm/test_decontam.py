import hashlib
import random
import re

from plait.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, body in items:
        x = words(body)
        size = min(window, len(x))
        wins = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if x else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in wins:
                hit.update(range(i, i + size))
                if name is not None:  # an item without an id hits, and cannot be named
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def check(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.report(d, b, **how).collect()}
    assert got == {i: brute(t, items, how.get("window", 10)) for i, t in docs}


def test_random_small_alphabet(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 8, 12, 20]))) for i in range(3, 30)] + [(1, None), (2, "--"), (None, "a b c")]
    check(spark, [(i, text(rng.randint(0, 80))) for i in range(60)] + [(100, None), (101, "")], items, window=6)
    check(spark, [(i, text(60)) for i in range(20)], [(i, text(30)) for i in range(5)])
    check(spark, [(i, text(60)) for i in range(20)], items, window=6, block_words=25)
    check(spark, [(1, "a b c")], [(1, None)])


def test_real_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    check(spark, [(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])


def test_remove(spark, docs):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = "nothing of it is here, not one two three."
    d = docs([(1, "Intro words come first and go on: " + item.upper().replace(" ", ", ") + "! Then é more text follows it here."), (2, clean), (3, item), (None, None), (5, "")])
    got = {r.doc_id: r for r in decontam.remove(d.selectExpr("*", "7 as n_words"), bench, most_cover=0.6).collect()}
    assert set(got) == {1, 2, None, 5} and got[2].text == clean and got[2].n_words == 7
    assert got[1].text == "Intro words come first and go on: ! Then é more text follows it here." and got[1].n_chars == len(got[1].text)
    assert got[None].text is None and decontam.remove(docs([]), bench).count() == 0
    assert decontam.remove(d, bench.limit(0)).count() == 5


def test_clashing_names_null_ids_and_a_long_text(spark, docs):
    ten = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(None, ten), (4, None), (4, "x y"), (4, "x y")], "item_id long, text string")
    d = spark.createDataFrame([(1, "a " + ten + " b", 5), (2, "x y", 6), (1, "w " * 2_500_000, 7)], "n_words long, spans string, items int")
    for how in ({}, {"block_words": 3}):
        got = sorted((r.n_words, r.n_hit, r.n_items) for r in decontam.report(d, bench, "n_words", "spans", **how).select("n_words", "n_hit", "n_items").collect())
        assert got == [(2, 2, 1), (12, 10, 0), (2_500_000, 0, 0)]
        left = {(r.n_words, r.items, r.spans[:5]) for r in decontam.remove(d, bench, "spans", most_cover=0.9, **how).collect()}
        assert left == {(1, 5, "a  b"), (1, 7, "w w w")}
