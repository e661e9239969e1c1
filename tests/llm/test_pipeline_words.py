"""The whole pipeline against brute force, near-dedup by five-word shingle sets of similarity 0.8."""

from collections import Counter

import corpus_pipeline
from plait.llm import decontam, langid
from tests.llm.test_decontam import words
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_neardup import brute_kept
from tests.llm.test_tokens import brute as encoded
from tests.llm.test_tokens import tokenizer  # noqa: F401


def runs(places):
    """Ascending places as (first, last + 1) runs."""
    out = []
    for k in sorted(places):
        if out and out[-1][1] == k:
            out[-1][1] = k + 1
        else:
            out.append([k, k + 1])
    return out


def test_run(spark, tokenizer):  # noqa: F811
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    rows = {r.doc_id: r for r in docs.collect()}
    langs, scores = model.score([r.text for r in rows.values()])
    known = [i for i, lang, score in zip(rows, langs, scores) if lang != "und" and score >= 0.5]
    kept = brute_kept([(i, rows[i].text) for i in known])
    assert len(kept) < len(known)
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    wins = {tuple(w[k : k + min(10, len(w))]) for w in items for k in range(max(1, len(w) - 9)) if w}
    clean = []
    for i in kept:
        text, w = rows[i].text, words(rows[i].text)
        hit = {k for win in wins for a in range(len(w) - len(win) + 1) if w[a] == win[0] and tuple(w[a : a + len(win)]) == win for k in range(a, a + len(win))}
        if len(hit) <= 0.5 * len(w):
            clean.append((i, decontam.cut_spans(text.encode(), runs(hit)).decode() if hit else text, rows[i].source))
    copies = {r[0]: r[4] // r[1] if r[1] else 0 for r in mixed(clean)}
    want = encoded(tokenizer, [(i, t) for i, t, _ in clean for _ in range(copies[i])])
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    assert Counter(got) == Counter(want) and len(want) > 100


def test_stages_take_nothing_and_nulls(spark, docs):
    sf = "/root/testdata/sf0.001"
    odd = docs([(None, None), (1, ""), (1, ""), (2, "the cat and the dog are here " * 3, "en", None), (3, "der hund und die katze sind da " * 3, "de", "s")])
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf)
        assert rows.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows.count() < 10
