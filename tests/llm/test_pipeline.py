from collections import Counter

import corpus_pipeline
from plait.llm import decontam, langid
from tests.llm.test_decontam import words
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_simhash import brute_components, brute_print
from tests.llm.test_tokens import brute as encoded
from tests.llm.test_tokens import tokenizer  # noqa: F401


def test_stages_against_brute_force(spark, tokenizer):  # noqa: F811
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    rows = {r.doc_id: r for r in docs.collect()}
    known = [i for i, g in zip(rows, model.score([r.text for r in rows.values()])[0]) if g != "und"]
    comp = brute_components([(i, brute_print(rows[i].text)) for i in known])
    kept = [i for i in known if comp[i] == i]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    wins = {tuple(w[k : k + min(10, len(w))]) for _, w in items for k in range(max(1, len(w) - 9)) if w}
    clean = []
    for i in kept:
        text, w = rows[i].text, words(rows[i].text)
        hit = {k for win in wins for a in range(len(w) - len(win) + 1) if w[a] == win[0] and tuple(w[a : a + len(win)]) == win for k in range(a, a + len(win))}
        if len(hit) <= 0.5 * len(w):
            spans = []
            for k in sorted(hit):
                if spans and spans[-1][1] == k:
                    spans[-1][1] = k + 1
                else:
                    spans.append([k, k + 1])
            clean.append((i, decontam.cut_spans(text.encode(), spans).decode() if spans else text, rows[i].source))
    copies = {r[0]: r[4] // r[1] if r[1] else 0 for r in mixed(clean)}
    want = encoded(tokenizer, [(i, t) for i, t, _ in clean for _ in range(copies[i])])
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    assert Counter(got) == Counter(want) and len(want) > 100
