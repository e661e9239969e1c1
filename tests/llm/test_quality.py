import numpy as np

from plait.llm import quality


def test_em_recovers_labellers():
    rng = np.random.default_rng(1)
    n, right = 20000, np.array([0.9, 0.8, 0.75, 0.6, 0.85])
    truth = rng.random(n) < 0.7
    hit = rng.random((n, 5)) < right
    v = np.where(hit == truth[:, None], 1, -1)
    v[rng.random((n, 5)) < 0.3] = 0
    pattern, where, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    good, table, share = quality.expectation_maximisation(pattern, counts.astype(float))
    accuracy = table[:, 1, 2] / (table[:, 1, 0] + table[:, 1, 2])
    assert np.abs(accuracy - right).max() < 0.03 and abs(share[1] - 0.7) < 0.03
    assert ((good[where.ravel()] > 0.5) == truth).mean() > ((v.sum(axis=1) > 0) == truth).mean()


def test_agrees_with_hidden_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.95
    assert got[got.quality == 0].keep.mean() < 0.5
    score = got.posterior + got.score
    good, bad = score[got.quality == 1].to_numpy(), score[got.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean() > 0.7


def test_reruns_nulls_and_no_rows(spark, docs):
    d = docs([(1, None), (2, ""), (2, ""), (None, "a few words. " * 40), (4, "### $$$ " * 50), (5, "word " * 60000)]).selectExpr("*", "1 as votes")
    a, b = ([tuple(r) for r in quality.classify(d.repartition(k)).collect()] for k in (1, 3))
    assert sorted(a, key=str) == sorted(b, key=str) and len(a) == 6
    assert quality.classify(docs([])).count() == 0


def test_votes_by_hand():
    assert quality.votes(None) == quality.votes(b" \n") == (-1,) + (0,) * (len(quality.LABELLERS) - 1)
    assert quality.votes(b"$$$ ### 123 456")[:3] == (-1, -1, -1)
    assert quality.votes(b"same line here\n" * 9)[3] == -1


def test_whole_rows_against_brute_force(spark):
    """EM over documents one by one and gradient descent on a dense matrix, in place of sums of patterns and sparse sums."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + [(500, None), (501, ""), (502, "!! $$ && " * 30)]
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    v = np.array([quality.votes(t.encode() if t else None) for _, t in rows])
    p = 1 / (1 + np.exp(-v.sum(axis=1)))
    for _ in range(100):
        w = np.array([1 - p, p])
        prior = (w.sum(axis=1) + 1) / (len(v) + 2)
        logs = np.log(prior)[:, None] + np.zeros((2, len(v)))
        right = []
        for j in range(v.shape[1]):
            t = np.array([[(w[c] * (v[:, j] == x)).sum() + 1 for x in (-1, 0, 1)] for c in (0, 1)])
            t /= t.sum(axis=1, keepdims=True)
            logs += np.log(t)[:, v[:, j] + 1]
            right.append((prior[0] * t[0, 0] + prior[1] * t[1, 2]) / sum(prior[c] * (t[c, 0] + t[c, 2]) for c in (0, 1)))
        p = np.exp(logs[1]) / np.exp(logs).sum(axis=0)
    assert np.allclose([got[i].posterior for i, _ in rows], p, atol=1e-5) and np.allclose(got[500].accuracies, right, atol=1e-4)
    words = [zlib_words(t) for _, t in rows]
    use = [k for k, x in enumerate(words) if x]
    names = sorted({x for k in use for x in words[k]})
    dense = np.array([[words[k].count(x) / len(words[k]) for x in names] for k in use])
    w, b, m, s, mb, sb = np.zeros(len(names)), 0.0, np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for t in range(1, 151):
        error = (1 / (1 + np.exp(-(dense @ w + b))) - p[use]) / len(use)
        g, gb = dense.T @ error + 1e-6 * w, error.sum() + 1e-6 * b
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        w, b = w - 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-10), b - 0.5 * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-10)
    score = {rows[k][0]: 1 / (1 + np.exp(-(dense[n] @ w + b))) for n, k in enumerate(use)}
    assert np.allclose([got[i].score for i in score], list(score.values()), atol=1e-3)
    mean = sorted(((r.posterior + r.score) / 2 for r in got.values()), reverse=True)
    kept = [r for r in got.values() if r.keep]
    assert len(kept) >= prior[1] * len(rows) and min((r.posterior + r.score) / 2 for r in kept) >= mean[len(kept) - 1] - 1e-3


def zlib_words(text):
    import zlib

    return [zlib.crc32(w) >> 17 for w in (text or "").encode().lower().split()]
