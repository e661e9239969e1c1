import random

from plait.llm import linededup


def n_words(line):
    return len(line.split())


def brute(rows, least):
    """All pairs of places of all texts: a run of equal lines with so many words goes from the later one."""
    docs = [((i is None, i or 0, k), k, t.split("\n")) for k, (i, t) in enumerate(rows) if t is not None]
    places = sorted((order, p, k, [x.strip(" ") for x in ls]) for order, k, ls in docs for p in range(len(ls)))
    at = {}
    for order, p, k, ls in places:
        at.setdefault(ls[p], []).append((order, p, k, ls))
    gone = {k: set() for k in range(len(rows))}
    for same in at.values():
        for n, (oa, p, _, a) in enumerate(same):
            for ob, q, kb, b in same[n + 1 :]:
                if p and q and a[p - 1] == b[q - 1]:
                    continue  # not the start of the run
                size = words = 0
                while p + size < len(a) and q + size < len(b) and a[p + size] == b[q + size]:
                    words += n_words(a[p + size])
                    size += 1
                if words >= least:
                    gone[kb].update(range(q, q + size))
    out = []
    for k, (i, t) in enumerate(rows):
        ls = [] if t is None else t.split("\n")
        out.append((str(i), len(ls), ",".join(map(str, sorted(gone[k]))), "\n".join(x for p, x in enumerate(ls) if p not in gone[k]) if t is not None else None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 6, 12, 30]))) for _ in range(40)] + ["", "  "]
    blocks = [[rng.choice(pool) for _ in range(rng.randint(1, 60))] for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(pool) for _ in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 2)):
            parts += rng.choice(blocks) + [rng.choice(pool)]
        rows.append((i, "\n".join(parts)))
    rows += [(None, None), (None, rows[3][1]), (7, rows[7][1]), (100, ""), (101, "\n\n")]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).selectExpr("*", "1 as gone", "2 as row", "3 as key")
    got = linededup.dedup(d, shingle_words=6, window_words=9).collect()
    want = brute(rows, 9)
    assert sorted([(str(r.doc_id), r.n_lines, r.deleted, r.text) for r in got], key=str) == want
    assert sum(r.n_deleted for r in got) > 200


def test_passage_of_over_50_words_is_always_found(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, passages = [], []
    for size in (1, 5, 11, 26, 60):
        passages.append([line(size) for _ in range(-(-56 // size) if size > 6 else 8)])
    for k, passage in enumerate(p for p in passages if sum(len(x.split()) for x in p) > 50):
        for i in range(3):
            rows.append((10 * k + i, "\n".join([line(7), line(9), *passage, line(8)])))
    got = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        n = len(text.split("\n"))
        assert got[i].n_deleted == (0 if i % 10 == 0 else n - 3), i
        if i % 10 == 0:
            assert got[i].text == text


def test_no_rows(docs):
    assert linededup.dedup(docs([])).count() == 0


def test_passages_of_short_lines(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda n, by=" ": by.join(word() for _ in range(n))
    blank = [x for _ in range(62) for x in (word(), "", " \t")]
    passages = [[line(1) for _ in range(62)], [line(2) for _ in range(31)], [line(rng.choice([1, 2])) for _ in range(200)], blank, [line(31, "\t"), line(31, "　")]]
    rows = [(10 * k + i, "\n".join([line(7), line(9), *p, line(8)])) for k, p in enumerate(passages) for i in range(3)]
    equal = "\n".join(["one two"] * 500)
    rows += [(100 + i, equal) for i in range(2)]
    got = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:-2]:
        assert got[i].n_deleted == (0 if i % 10 == 0 else len(text.split("\n")) - 3), i
    assert got[100].n_deleted > 480 and got[101].n_deleted == 500


def shared(spark, *texts, **how):
    """Deleted lines by row of these texts."""
    got = linededup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **how).collect()
    return {r.doc_id: r.deleted for r in got}


def test_a_run_shared_with_another_row_than_the_first(spark):
    rng = random.Random(3)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    run, tail = line(25), [line(2) for _ in range(6)]
    texts = ["\n".join([run, line(9)]), "\n".join([run, *tail, line(7)]), "\n".join([line(5), run, *tail, line(8)])]
    assert shared(spark, *texts) == {0: "", 1: "0", 2: "1,2,3,4,5,6,7"}
    # a hot line before: what follows is shared with the second only
    y = [line(15), line(15)]
    texts = ["\n".join([run, line(9)]), "\n".join([run, *y, line(4)]), "\n".join([run, *y, line(4)])]
    assert shared(spark, *texts)[2] == "0,1,2"


def test_lists_and_verse(spark):
    rng = random.Random(4)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    for lines in ([line(2) for _ in range(200)], [x for _ in range(100) for x in (line(4), "")], [line(1) for _ in range(20)]):
        got = shared(spark, "\n".join([line(3), *lines]), "\n".join([line(3), line(1), *lines]))
        assert got[0] == "" and got[1] == ",".join(map(str, range(2, 2 + len(lines))))
    assert shared(spark, "\n".join(line(1) for _ in range(19)), "x") == {0: "", 1: ""}


def test_growing_versions_and_a_very_long_text(spark):
    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    log = [line(3) for _ in range(60)]
    texts = ["\n".join(log[:n]) for n in range(10, 60, 5)]
    rows = list(enumerate(texts))
    assert sorted((str(k), d) for k, d in shared(spark, *texts).items()) == sorted((r[0], r[2]) for r in brute(rows, 20))
    long = "\n".join(line(10) for _ in range(6000))  # 400 kB in 6000 lines
    got = shared(spark, long, "w " * 2_500_000, line(30) + "\n" + long)
    assert got[0] == got[1] == "" and got[2] == ",".join(map(str, range(1, 6001)))


def test_native(spark):
    plan = linededup.dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
