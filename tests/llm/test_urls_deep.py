"""Templates of deep paths against the tree worked out level by level in Python, and time by branching."""

import random
import time
from collections import Counter, defaultdict

from plait.llm import urls


def agrees(k, n, k_pool, n_pool, z=2.33):
    share = k_pool / n_pool if n_pool > 0 else 0.0
    expected = n * share
    if expected < 5 or n - expected < 5:
        return True
    return (k - expected) ** 2 <= z * z * expected * (1 - share)


def level_by_level(rows):
    """Templates of (host, segments, bad) at every depth in turn, without a limit."""
    n, seen, bad = Counter(), Counter(), Counter()
    for host, segs, b in rows:
        key = (host, segs)
        n[key] += 1
        seen[key] += b is not None
        bad[key] += b or 0
    tree = {k: list(k[1]) for k in n}
    depth = max((len(t) for t in tree.values()), default=0)
    for d in range(depth):
        children = Counter()
        for key, t in tree.items():
            if len(t) > d:
                children[key[0], tuple(t[:d]), t[d]] += n[key]
        parents = defaultdict(list)
        for (host, parent, seg), c in children.items():
            parents[host, parent].append(c)
        for key, t in tree.items():
            if len(t) > d and len(parents[key[0], tuple(t[:d])]) > 12 and not t[d].startswith("{"):
                if children[key[0], tuple(t[:d]), t[d]] < 0.05 * sum(parents[key[0], tuple(t[:d])]):
                    tree[key] = t[:d] + ["*"] + t[d + 1 :]
    for d in reversed(range(depth)):
        cells = defaultdict(lambda: [0, 0, 0])
        for key, t in tree.items():
            if len(t) > d + 1 and t[d] != "*" and not t[d].startswith("{"):
                cell = cells[key[0], tuple(t[:d]), t[d], "/".join(t[d + 1 :])]
                for i, c in enumerate((n, bad, seen)):
                    cell[i] += c[key]
        branches = defaultdict(list)
        for (host, parent, seg, sub), cell in cells.items():
            branches[host, parent, seg].append((sub, cell))
        tops, pools = {}, defaultdict(lambda: [0, 0, 0, 0, 0])
        for key, subs in branches.items():
            top, (o, _, _) = min(subs, key=lambda x: (-x[1][0], x[0]))
            total = [sum(c[i] for _, c in subs) for i in range(3)]
            tops[key] = (top, o, total)
            for i, v in enumerate((total[0], o, total[1], total[2], 1)):
                pools[key[0], key[1], top][i] += v
        largest = {}
        for (host, parent, top), pool in pools.items():
            largest[host, parent] = min(largest.get((host, parent), (0, "")), (-pool[0], top))
        names = {}
        for (host, parent, seg), (top, o, (total, b, s)) in tops.items():
            n_pool, o_pool, b_pool, s_pool, k = pools[host, parent, top]
            if agrees(o, total, o_pool, n_pool) and agrees(b, s, b_pool, s_pool):
                if (d == 0 or k > 1) and largest[host, parent][1] == top:
                    names[host, parent, seg] = "{~}"
                elif k > 1:
                    names[host, parent, seg] = "{~" + top + "}"
        for key, t in tree.items():
            if len(t) > d and (to := names.get((key[0], tuple(t[:d]), t[d]))):
                tree[key] = t[:d] + [to] + t[d + 1 :]
    return {k: "/".join(t) for k, t in tree.items()}


def test_every_depth_against_python(spark):
    r = random.Random(3)
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    rows = []
    for i in range(3000):
        segs = [r.choice(["a", "b", "c"])]
        segs += ["same"] * r.choice([0, 3, 7])
        for _ in range(r.randint(0, 9)):
            segs.append(r.choice(["x", "y", "{~}", word(r.randrange(300)), str(r.randrange(50)), "long/chain/of/parts"]))
        rows.append((i, f"http://{r.choice(['p.test', 'q.test'])}/" + "/".join(segs)))
    rules = (("block", "p.test/a/"), ("allow", "q.test/"), ("block", "p.test/b/same/1"))
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge(df, rules=rules).collect()
    shapes = df.select("page_id", urls.shape(urls.parts(df.url)[1]).alias("s")).collect()
    host = {x.page_id: x.host for x in got}
    say = {x.page_id: {"p.test/a/": 1, "p.test/b/same/1": 1, "q.test/": 0}.get(x.rule) for x in got}
    want = level_by_level([(host[x.page_id], tuple(x.s), say[x.page_id]) for x in shapes])
    assert {x.page_id: x.template for x in got} == {x.page_id: want[host[x.page_id], tuple(x.s)] for x in shapes}
    assert max(len(x.s) for x in shapes) > 20


def test_long_shared_paths(spark):
    deep = "http://l.test/" + "/".join(f"p{'q' * (k % 7)}" for k in range(1000))
    rows = [(1, deep + "/a"), (2, deep + "/b/c"), (3, deep + "/b/d"), (4, deep), (5, deep[:-40])]
    spark.range(1).count()
    began = time.time()
    got = {r.page_id: r.template for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert time.time() - began < 60
    assert len(got) == 5 and got[1].endswith("/a") and got[2].count("/") == got[3].count("/") == 1001


def test_two_very_long_paths(spark):
    deep = "http://l.test/" + "/".join(["ab"] * 200_000)
    got = urls.judge(spark.createDataFrame([(1, deep + "/x"), (2, deep + "/y/z")], "page_id long, url string").selectExpr("*", "1 as template")).collect()
    assert sorted(len(r.template.split("/")) for r in got) == [200_001, 200_002]
