"""SimHash proposes the near copies of the pipeline's stage; sets decide; what it tells apart is found all the same."""

import random

import corpus_pipeline
from plait.llm import neardup, simhash
from plait.plans.components import connected_components
from plait.plans.staging import Scratch
from tests.llm.test_neardup import brute_kept, edited


def texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(6):  # one word of 3,000, which few bits show, and of 60, which many do
        for n in (3000, 60):
            base = [word() for _ in range(n)]
            rows += [" ".join(base), " ".join(edited(rng, base, 1))]
    return list(enumerate(rows))


def test_stage_goes_by_simhash_first(spark, docs, monkeypatch):
    rows, seen, asked = texts(), [], []
    links, verified = simhash.links, neardup._verified
    monkeypatch.setattr(simhash, "links", lambda prints, scratch, most=2: seen.append(prints.count()) or links(prints, scratch, most))

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(neardup, "_verified", counted)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(rows), "").collect())
    assert got == brute_kept(rows) == list(range(0, 24, 2))
    assert len(seen) == 1 and asked[0] >= 3 and asked[1] >= 3  # some by SimHash, the others by the exact way
    assert asked[0] + asked[1] == 12  # and no pair by both


def test_prints_of_the_sets(spark, docs):
    rows = texts()
    by_print = {i: simhash.fingerprint_of(neardup.shingles(t.encode())) for i, t in rows}
    want = {(i, j) for i in by_print for j in by_print if i < j and (by_print[i] ^ by_print[j]).bit_count() <= 2}
    table = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in by_print.items()], "row long, fp long")
    with Scratch(spark) as scratch:
        pairs = neardup.alike(table.union(table.where("row = 3").selectExpr("99L", "fp")), scratch)
        roots = {r.node: r.root for r in connected_components(pairs).collect()}
    assert {(i, j) for i in roots for j in roots if i < j and roots[i] == roots[j] and 99 not in (i, j)} == want and roots[99] == roots.get(3, 3)
