import itertools
import random
import re

import xxhash

from plait.llm import simhash
from plait.plans.components import connected_components
from plait.plans.staging import Scratch


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """id → least id reachable; prints: list of (id, fp)."""
    parent = {i: i for i, _ in prints}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for (i, a), (j, b) in itertools.combinations(prints, 2):
        if bin(a ^ b).count("1") <= 2:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: find(i) for i in parent}


def test_fingerprint():
    for text in [None, "", "  \n", "One", "one TWO", "a b c", "É b\x0bc d\x1ce f", "x y z " * 40]:
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_print(text)


def test_spark_hash_is_the_same(spark):
    got = spark.sql("select xxhash64('one two three') h").first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_whole_operator_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    d = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + [(1000, None), (1001, ""), (1002, "Hi"), (1003, "hi")], "doc_id long, text string")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(d).collect()}
    prints = [(r.doc_id, brute_print(r.text)) for r in d.collect()]
    want = brute_components(prints)
    assert got == {i: (f, want[i]) for i, f in prints}


def test_crowded_cells_keep_components(spark):
    rng = random.Random(5)
    prints = set()
    for base in (0, rng.getrandbits(64), rng.getrandbits(64), 2**64 - 1):
        for _ in range(60):
            f = base
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in prints]
    df = spark.createDataFrame(signed, "fp long")
    want = brute_components([(f, f % 2**64) for (f,) in sorted(signed)])
    with Scratch(spark) as scratch:
        roots = {r.node: r.root for r in connected_components(simhash.links(df, scratch)).collect()}
    assert {f: roots.get(f, f) for (f,) in signed} == want


def test_components_of_a_long_chain_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(7, 7), (None, 3), (200, 201), (201, 200)], "a long, b long")
    got = {r.node: r.root for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}
    assert connected_components(chain.limit(0)).count() == 0


def test_keep_one(spark, docs):
    d = docs([(5, "a b c d e"), (3, "A b c d e"), (3, "a b c d e"), (9, "something else is here"), (None, "nothing else like this one"), (None, None), (4, "")])
    kept = simhash.keep_one(d.selectExpr("*", "'x' as key"))
    assert kept.columns == d.columns + ["key"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 4), (False, 9), (True, 0)]
    assert simhash.keep_one(docs([])).count() == 0 and simhash.near_duplicates(docs([])).count() == 0


def test_clashing_names(spark, docs):
    d = docs([(5, "a b c d e"), (3, "A b c d e"), (9, "something else is here")]).selectExpr("*", "5 as __row", "'x' as row", "'y' as rest", "1 as id", "0 as fp")
    assert {(r.doc_id, r["__row"], r.row, r.rest, r.id, r.fp) for r in simhash.keep_one(d).collect()} == {(3, 5, "x", "y", 1, 0), (9, 5, "x", "y", 1, 0)}
    got = simhash.near_duplicates(d.selectExpr("doc_id as fp", "text as component_id"), "fp", "component_id").collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (9, 9)]


def test_lattice_cells_of_all_pairs():
    """Points at Hamming distance 2 or less share a cell, by the bound of the segments' counts."""
    rng = random.Random(3)
    def cells(f):
        home = [(f >> 2 * k & 1) + (f >> 2 * k + 1 & 1) for k in range(32)]
        return {tuple(home)} | {tuple(c + d * (i == k) for i, c in enumerate(home)) for k in range(32) for d in (-1, 1) if 0 <= home[k] + d <= 2}
    for _ in range(300):
        f = rng.getrandbits(64)
        g = f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert cells(f) & cells(g)


def test_hot_key_is_split(spark):
    """One node with most of the edges: the join with the staged aggregate is dealt anew."""
    from plait.plans import components

    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                                          "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.coalescePartitions.enabled") if spark.conf.get(k, None) is not None}
    new = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
           "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        edges = spark.range(1, 60000).selectExpr("if(id % 10 = 0, id, 0) as b", "id + 100000 as a").repartition(8)
        with Scratch(spark) as scratch:
            out = components._star(edges, True, scratch)
            out.collect()
            assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in new:
            spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)
