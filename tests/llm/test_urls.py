import re

from plait.llm import urls


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for say, rule in urls.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (say, rule)
    return host, path, best[1] if best else None, best[0] if best else None


def test_parts_and_rules(spark):
    given = [None, "", "no scheme", "http://", "http://A.B.Example.ORG/es/1?x#y", "https://example.org/en/12", "http://xexample.org/es/", "http://org", "http://org/", "http://É.com/fr/x://y",
             "http://com/de/1", "http://com?x=/de/", "ftp://a.com#/fr/", "http://x.org\n/es/", "http://a.example.org/en/1"]
    d = spark.createDataFrame([(i, u, u) for i, u in enumerate(given)] + [(0, None, "")], "page_id long, url string, host string")
    got = urls.judge(d).collect()
    assert len(got) == len(given) + 1
    for r in got:
        host, path, rule, say = brute(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ([say] if say else ["allow", "block"]), r
    assert urls.judge(d.limit(0)).count() == 0


def test_templates_by_purity(spark):
    rows = [(i, f"http://h.test/bad/{i}") for i in range(30)] + [(100 + i, f"http://h.test/good/{i}/x.html") for i in range(30)]
    rows += [(200 + i, f"http://h.test/{w}/item/{i}") for i in range(40) for w in ("a", "b")]
    rules = (("block", "h.test/bad/1"), ("block", "h.test/bad/2"), ("allow", "h.test/good/1"))
    got = {(r.path.split("/")[1], r.verdict, r.template) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert {(b, v) for b, v, _ in got} == {("bad", "block"), ("good", "allow"), ("a", "allow"), ("b", "allow")}


def test_variable_segments(spark):
    rows = [(i, f"http://u.test/user/{chr(97 + i % 26)}{chr(97 + i // 26)}zz/home") for i in range(100)]
    assert {r.template for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()} == {"{~}/*/home"}


def table(spark, rows, **how):
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), **how).collect()
    return {r.page_id: (r.template, r.verdict) for r in got}


def test_deep_paths_are_told_apart(spark):
    rows = [(100 * k + i, f"http://d.test/a/b/c/d/e/f/{seg}/{i}/z") for k, seg in enumerate("ghk") for i in range(40)]
    rules = (("block", "d.test/a/b/c/d/e/f/g/"), ("allow", "d.test/a/b/c/d/e/f/h/1"))
    got = table(spark, rows + [(900, "http://d.test/a/b/c/d/e/f/g/x/y")], rules=rules)
    assert {got[i][1] for i in range(40)} == {"block"} and {v for i, (_, v) in got.items() if 100 <= i < 300} == {"allow"}
    assert all(len(t.split("/")) == 9 for i, (t, _) in got.items() if i < 900)


def test_variable_segments_below_a_wildcard(spark):
    name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(4))
    rows = [(i, f"http://u.test/user/{name(i)}/post/{name(7 * i + 3)}") for i in range(300)]
    assert len({t.split("/", 1)[1] for t, _ in table(spark, rows).values()}) == 1
    assert {t.split("/")[-1] for t, _ in table(spark, rows).values()} == {"*"}


def test_similar_branches_merge_at_every_level(spark):
    def pages(base, prefix, n, share):  # n pages below a branch, the share of them lists and the rest items
        return [(base + i, f"http://m.test/{prefix}/{i}/{'list' if i < share * n else 'item'}") for i in range(n)]

    rows = pages(0, "s/hot", 900, 0.1)
    for k, word in enumerate(("red", "blue", "green")):  # like one another, not like the hot one
        rows += pages(1000 + 100 * k, f"s/{word}", 60, 0.9)
    rows += pages(2000, "s/odd", 60, 0.55)  # most are lists as well, but not so many
    got = table(spark, rows)
    below = {k: {t.split("/")[1] for i, (t, _) in got.items() if lo <= i < hi} for k, lo, hi in (("hot", 0, 900), ("three", 1000, 1300), ("odd", 2000, 2100))}
    assert len(below["three"]) == 1 and not below["three"] & below["hot"] and below["odd"] == {"odd"}


def test_branches_with_other_labels_stay_apart(spark):
    rows = [(100 * k + i, f"http://h.test/{seg}/{i}") for k, seg in enumerate(("bad", "good")) for i in range(60)]
    got = table(spark, rows, rules=(("block", "h.test/bad/1"), ("block", "h.test/bad/2"), ("allow", "h.test/good/1"), ("allow", "h.test/good/2")))
    assert {v for i, (_, v) in got.items() if i < 100} == {"block"} and {v for i, (_, v) in got.items() if i >= 100} == {"allow"}


def test_a_long_path(spark):
    assert len(table(spark, [(1, "http://l.test/" + "/".join(["ab"] * 1_000_000) + "?" + "q" * 2_000_000), (2, None)])) == 2
