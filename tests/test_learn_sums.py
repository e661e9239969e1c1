import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plait.operators import align, learn
from plait.operators.reads import stable_symbols
from plait.queries import WIDTH, fixed_networks
from plait.sources import text


def made(spark, n=60, seed=1):
    r = random.Random(seed)
    return [(i, "".join(r.choice("acgt- ") for _ in range(WIDTH))) for i in range(n)]


@pytest.mark.parametrize("kind", ["tanh", "softmax"])
def test_activations_and_accuracy(spark, kind):
    rows = made(spark) + [(900, None), (901, " " * WIDTH)]
    models = fixed_networks(spark)
    nets = {m.v: (np.array(m.w0).reshape(-1, 5), np.array(m.b0), np.array(m.w1).reshape(5, 5), np.array(m.b1)) for m in models.collect()}
    hot = learn.one_hot([s or "" for _, s in rows], WIDTH).astype(float)
    df = spark.createDataFrame(rows, "sig_id long, sig string").repartition(5)
    got = {(r.v, r.layer, r.unit): (r.n, r.mean) for r in learn.activations(df, models, WIDTH, kind=kind).collect()}
    told = {r.v: r for r in learn.accuracy(df, models, WIDTH, kind=kind, decay=0.01).collect()}
    assert len(got) == WIDTH * 10
    for v in (0, 7, WIDTH - 1):
        y = hot[:, 5 * v : 5 * v + 5]
        seen = y.sum(axis=1) > 0
        h, z = learn.forward(np.delete(hot, slice(5 * v, 5 * v + 5), axis=1)[seen], nets[v], kind)
        for layer, means in enumerate((h.mean(axis=0), z.mean(axis=0))):
            for unit, m in enumerate(means):
                n, mean = got[v, layer, unit]
                assert n == seen.sum() and abs(mean - m) < 1e-9
        y = y[seen]
        cost = ((z - y) ** 2).sum(axis=1).mean() / 2 + 0.01 * sum((w**2).sum() for w in nets[v])
        right = (z.argmax(axis=1) == y.argmax(axis=1)).mean()
        assert abs(told[v].cost - cost) < 1e-9 and told[v].correct == int(1000 * right + 1e-9) / 10
        assert told[v].targets == y.sum(axis=0).astype(int).tolist() and told[v].answers == np.bincount(z.argmax(axis=1), minlength=5).tolist()
    assert learn.activations(df.limit(0), models, WIDTH).count() == 0
    none = learn.accuracy(spark.createDataFrame([(1, " " * WIDTH)], "sig_id long, sig string"), models, WIDTH).first()
    assert (none.n, none.cost, none.correct, none.targets) == (0, None, None, [0] * 5)


@pytest.mark.parametrize("lag,mask,rounds", [(1, True, 4), (2, False, 6), (2, True, 3), (1, False, 1)])
def test_rounds_of_what_changes(spark, lag, mask, rounds):
    rows = made(spark, 80, 2)
    models, df = fixed_networks(spark), spark.createDataFrame(rows, "sig_id long, sig string")
    sizes = []
    got, first = learn.correct(df, models, WIDTH, rounds=rounds, mask=mask, lag=lag, sizes=sizes)
    now, cells = df, []
    for k in range(rounds + 1):
        cells.append(now.select("sig_id", F.lit(k).alias("round"), F.posexplode(F.split("sig", "")).alias("v", "base")))
        if k == 1:
            assert sorted(map(tuple, first.collect())) == sorted(map(tuple, now.collect()))
        now = spark.createDataFrame(learn.predict(now, models, WIDTH, mask=mask).collect(), "sig_id long, sig string")
    every = cells[0]
    for c in cells[1:]:
        every = every.unionByName(c)
    want = {}
    for r in stable_symbols(every, rounds, lag).collect():
        want.setdefault(r.sig_id, {})[r.v] = r.base
    want = {i: "".join(b for _, b in sorted(d.items())) for i, d in want.items()}
    assert {r.sig_id: r.sig for r in got.collect()} == want
    assert sizes == sorted(sizes, reverse=True) and sizes[0] <= 80


def test_fewer_rows_every_round(spark):
    # a network that answers with its neighbour's symbol: a run of equal symbols is stable at once, others move on
    rng = random.Random(6)
    kinds = ["acgtacgtacgt", "ccgtaagtacta", "acctacgaacgg"]
    noisy = [(i, "".join(rng.choice("acgt") if rng.random() < 0.08 else c for c in kinds[i % 3])) for i in range(240)]
    df = spark.createDataFrame(noisy, "sig_id long, sig string")
    models = learn.train(df, 12, range(12), rounds=60, stop=101)
    sizes = []
    learn.correct(df, models, 12, rounds=6, sizes=sizes)
    assert sizes[-1] < sizes[0] < 240 and sizes == sorted(sizes, reverse=True)


def test_bit_vectors_equal_rows():
    r = random.Random(3)
    word = lambda n, a="acgt": "".join(r.choice(a) for _ in range(n))
    patterns = [word(n) for n in (1, 2, 63, 64, 65, 127, 128, 129, 200)] + ["äöx" * 5, "acgt" * 30]
    texts = ["", "a", word(40), word(150), word(300), "äx" * 9, "acgt" * 30, word(64, "ab")]
    pairs = [(p, t) for p in patterns for t in texts]
    both = [align.last_rows([p for p, _ in pairs], [t for _, t in pairs], bits=b) for b in (True, False)]
    assert all(a.tolist() == b.tolist() for a, b in zip(*both))
    assert align.semi_globals(["acg"] * 3000, ["ttacgtt"] * 3000)[7] == (0, 5)


def test_bit_vectors_are_faster():
    import time

    rng = np.random.default_rng(0)
    word = lambda n: "".join(np.array(list("acgt"))[rng.integers(0, 4, n)])
    patterns, texts = [word(120) for _ in range(2000)], [word(600) for _ in range(2000)]
    took = []
    for bits in (True, False):
        began = time.process_time()
        align.last_rows(patterns, texts, bits=bits)
        took.append(time.process_time() - began)
    assert took[0] < 0.6 * took[1], took


def test_rejected_rows(spark, tmp_path):
    lines = ["ACGT", "ac_t", "acgtt", "acxt", "", "ac t", "AC"]
    path = tmp_path / "sigs"
    path.write_text("\n".join(lines) + "\n")
    out = text.checked_signatures(spark, f"file://{path}")
    assert sorted(map(tuple, out.rows.collect())) == [(0, "acgt"), (1, "ac-t"), (5, "ac t")]
    assert sorted(map(tuple, out.rejected.collect())) == [(2, "acgtt", "width"), (3, "acxt", "alphabet"), (6, "ac", "width")]
    assert out.counts == {"all": 6, "width": 2, "alphabet": 1}
    narrow = text.checked_signatures(spark, f"file://{path}", 2)
    assert narrow.rows.count() == 1 and narrow.counts == {"all": 6, "width": 5}
    (tmp_path / "none").write_text("")
    assert text.checked_signatures(spark, f"file://{tmp_path}/none").counts == {"all": 0}
    placed = text.checked_placements(spark.createDataFrame([(1, 3, 10), (2, 2, 10), (3, None, 10), (4, 0, 0)], "id int, dist int, len int"))
    assert [r.id for r in placed.rows.collect()] == [2] and placed.counts == {"all": 4, "errors": 3}
