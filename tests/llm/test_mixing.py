import hashlib
import math
import re

from plait.llm import mixing


def brute(rows, weights=(1, 2, 3)):
    size = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    order = sorted({s for _, _, s in size}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for _, n, x in size if x == s) for s in order}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    goal, full = {}, set()
    while True:
        left, w = sum(total.values()) - sum(3 * total[s] for s in full), sum(weight[s] for s in order if s not in full)
        goal = {s: 3.0 * total[s] if s in full else left * weight[s] / w for s in order}
        more = {s for s in order if s not in full and goal[s] > 3 * total[s]}
        if not more:
            break
        full |= more
    out = []
    for i, n, s in size:
        rate = goal[s] / total[s] if total[s] else 0
        u = int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        out.append((i, n, total[s], round(goal[s], 4), n * (math.floor(rate) + (u < rate % 1))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [(i, "w " * (i % 17 * (5 if i % 3 else 1)), ["a", "b", "é", "Z", None, "empty"][min(i % 9, 5) if i % 9 < 5 else 0]) for i in range(400)]
    rows += [(None, "a b", "b"), (3, None, "a"), (3, None, "a"), (900, "", "empty"), (901, "one\x0btwo\x1cthree", "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as copies", "3 as rank")
    plan = mixing.plan(d)
    got = sorted([(r.doc_id, r.size, r.source_size, round(r.target, 4), r.size * r.copies) for r in plan.collect()], key=str)
    assert got == brute(rows)
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns and mixed.count() == sum(r.copies for r in plan.collect())


def test_taken_comes_near_target(spark):
    d = spark.range(20000).selectExpr("id as doc_id", "repeat('w ', 10) as text", "if(id % 5 = 0, 'x', 'y') as source")
    for r in mixing.plan(d).groupBy("source", "target").agg({"copies": "sum"}).collect():
        assert abs(10 * r["sum(copies)"] - r.target) < 0.03 * r.target


def test_none_and_all_empty(spark, docs):
    assert mixing.plan(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0
    assert [(r.size, r.target, r.copies) for r in mixing.plan(docs([(1, None)])).collect()] == [(0, 0.0, 0)]
