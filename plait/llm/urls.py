"""URL filter: rules first, then a path-template tree judged by smoothed labelled purity.

Everything is DataFrame functions.  Paths become shapes (digits, hex and mixed segments as wildcards);
pages are summed to one row per host and shape before anything else, and the tree is that of the shapes.  It is a
radix tree: a pass takes the next place at which the shapes below each node differ, so passes cost by how often
a path branches and not by how long it is.  From the root down, a node with many children, under the wildcards found
above it, turns its rare children into a wildcard too.  From the leaves up, branches of one node that have the same
commonest sub-template below them are compared with all such branches together, by its share and by the share of
blocked among labelled pages (chi-square tests of two cells, where five or more are expected in both); those that
agree become one.  A template is rejected if the share of blocked among its labelled pages, smoothed towards its
host's share and that towards all pages', reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.llm.schemas import quoted
from plait.plans.staging import Scratch

#: The order of the contract; a rule's host ends at its first slash.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The least count that a test expects in a cell.
LEAST_EXPECTED = 5.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls; of equally long ones the first."""
    name = verdict = None
    for say, rule in sorted(rules, key=lambda r: -len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    null = F.lit(None).cast("string")
    return (null, null) if name is None else (name, verdict)


def shape(path: Column) -> Column:
    """The path's segments, variable ones as wildcards; slashes that repeat count once."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike(r"^[0-9]+$"), "{n}").when(s.rlike(r"^[0-9]+\.[A-Za-z]+$"), F.concat(F.lit("{n}"), F.regexp_extract(s, r"\.[A-Za-z]+$", 0)))
                       .when(s.rlike(r"^[0-9a-fA-F]{8,}$"), "{h}").when(s.rlike(r"[0-9]") & (F.length(s) >= 6), "{x}").otherwise(s))


def _at(tree: DataFrame, d: Column) -> DataFrame:
    """``tree`` with parent, seg and sub: what stands before, at and after place ``d`` of ``t``; seg is null in shorter ones and where ``d`` is null."""
    rest = F.array_join(F.slice("t", d + 2, F.greatest(F.size("t") - d - 1, F.lit(0))), "/")
    return tree.withColumn("parent", F.array_join(F.slice("t", F.lit(1), d), "/")).withColumn("seg", F.get("t", d)).withColumn("sub", rest)


def _renamed(tree: DataFrame, d: Column, names: DataFrame) -> DataFrame:
    """``tree`` with place ``d`` of ``t`` as ``names(host, parent, seg, to)`` have it."""
    keys = ["host", "parent", "seg"]
    named = _at(tree, d).join(names.select(*keys, "to"), keys, "left")
    after = F.slice("t", d + 2, F.greatest(F.size("t") - d - 1, F.lit(0)))
    return named.withColumn("t", F.when(F.col("to").isNotNull(), F.concat(F.slice("t", F.lit(1), d), F.array("to"), after)).otherwise(F.col("t"))).select(tree.columns)


def _wild(tree: DataFrame, d: Column, most_children: int, least_share: float, scratch: Scratch) -> DataFrame:
    """Rare children of crowded nodes at place ``d`` become ``*``."""
    children = scratch.stage(_at(tree, d).where("seg is not null").groupBy("host", "parent", "seg").agg(F.sum("n").alias("n_child")), "children")
    parents = children.groupBy("host", "parent").agg(F.count("*").alias("children"), F.sum("n_child").alias("n_parent")).where(F.col("children") > most_children)
    rare = children.join(parents, ["host", "parent"]).where(~F.col("seg").startswith("{") & (F.col("n_child") < least_share * F.col("n_parent")))
    return scratch.stage(_renamed(tree, d, rare.withColumn("to", F.lit("*"))), "tree")


def _next_branching(tree: DataFrame, d: Column, scratch: Scratch) -> DataFrame:
    """``tree`` with one more of ``stops``: the next place after ``d`` at which the shapes with the same beginning differ, or null.

    What many shapes have in common is what the first and the last of them in order have.
    """
    goes_on = _at(tree, d).withColumn("node", F.when(F.col("seg").isNotNull() & (F.size("t") > d + 1), F.array_join(F.slice("t", F.lit(1), d + 1), "/")))
    rest = F.slice("t", d + 2, F.size("t") - d - 1)
    ends = goes_on.where("node is not null").groupBy("host", "node").agg(F.min(rest).alias("low"), F.max(rest).alias("high"))
    differs = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    ahead = scratch.stage(ends.where("low != high").select("host", "node", differs.alias("ahead")), "branching")
    return scratch.stage(goes_on.join(ahead, ["host", "node"], "left").withColumn("stops", F.array_append("stops", d + F.col("ahead"))).select(tree.columns), "tree")


def _agrees(k: Column, n: Column, k_pool: Column, n_pool: Column, z: float) -> Column:
    """Whether ``k`` of ``n`` is like ``k_pool`` of ``n_pool``; where too few are expected, nothing speaks against it."""
    share = F.when(n_pool > 0, k_pool / n_pool).otherwise(0.0)
    expected = n * share
    known = (expected >= LEAST_EXPECTED) & (n - expected >= LEAST_EXPECTED)
    return ~known | ((k - expected) * (k - expected) <= z * z * expected * (1.0 - share))


def _merged(tree: DataFrame, d: Column, first: bool, z: float, scratch: Scratch) -> DataFrame:
    """Branches at place ``d``, which is that of hosts' first segments or not, with something below them that agree become one."""
    cells = _at(tree, d).where("seg is not null and sub != '' and seg != '*' and not startswith(seg, '{')").groupBy("host", "parent", "seg", "sub").agg(
        F.sum("n").alias("o"), F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
    tops = cells.groupBy("host", "parent", "seg").agg(F.sum("o").alias("n_branch"), F.min(F.struct((-F.col("o")).alias("m"), "sub")).alias("top"), F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
    branches = scratch.stage(tops.select("host", "parent", "seg", "n_branch", "bad", "seen", F.col("top.sub").alias("top"), (-F.col("top.m")).alias("o")), "branches")
    pools = branches.groupBy("host", "parent", "top").agg(F.sum("n_branch").alias("n_pool"), F.sum("o").alias("o_pool"), F.sum("bad").alias("bad_pool"), F.sum("seen").alias("seen_pool"), F.count("*").alias("k"))
    largest = pools.groupBy("host", "parent").agg(F.min(F.struct((-F.col("n_pool")).alias("m"), "top"))["top"].alias("largest"))
    pools = scratch.stage(pools.join(largest, ["host", "parent"]), "pools")
    agrees = _agrees(F.col("o"), F.col("n_branch"), F.col("o_pool"), F.col("n_pool"), z) & _agrees(F.col("bad"), F.col("seen"), F.col("bad_pool"), F.col("seen_pool"), z)
    several = F.lit(first) | (F.col("k") > 1)  # a host's first segment is one of many hosts' sections
    name = F.when(several & (F.col("top") == F.col("largest")), "{~}").when(F.col("k") > 1, F.concat(F.lit("{~"), "top", F.lit("}")))
    names = branches.join(pools, ["host", "parent", "top"]).where(agrees).withColumn("to", name).where("to is not null")
    return scratch.stage(_renamed(tree, d, names), "tree")


def templates(labelled: DataFrame, scratch: Scratch, most_children: int = 12, least_share: float = 0.05, z: float = 2.33, strength: float = 4.0) -> DataFrame:
    """``labelled(host, segs, bad)``, bad 1, 0 or null → host, segs, template and its smoothed ``purity``."""
    shapes = scratch.stage(labelled.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "shapes")
    tree, passes = shapes.withColumn("t", F.col("segs")).withColumn("stops", F.array(F.lit(0))), 0
    while not passes or not tree.where(F.get("stops", F.lit(passes)).isNotNull()).isEmpty():
        tree = _wild(tree, F.get("stops", F.lit(passes)), most_children, least_share, scratch)
        tree = _next_branching(tree, F.get("stops", F.lit(passes)), scratch)
        passes += 1
    for k in reversed(range(passes)):
        tree = _merged(tree, F.get("stops", F.lit(k)), k == 0, z, scratch)
    tree = scratch.stage(tree.withColumn("template", F.array_join("t", "/")), "named")
    total = shapes.agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen")).select(((F.coalesce("bad", F.lit(0)) + 1.0) / (F.coalesce("seen", F.lit(0)) + 2.0)).alias("base"))
    by_host = shapes.groupBy("host").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen")).crossJoin(F.broadcast(total)).select(  # one row
        "host", ((F.col("bad") + strength * F.col("base")) / (F.col("seen") + strength)).alias("host_rate"))
    sums = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
    by_template = scratch.stage(sums.join(by_host, "host").select("host", "template", ((F.col("bad") + strength * F.col("host_rate")) / (F.col("seen") + strength)).alias("purity")), "purity")
    return tree.join(by_template, ["host", "template"]).select("host", "segs", "template", "purity")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, threshold: float = 0.8, **how) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every row.

    The rules' verdicts are the labels.  A page without a rule is blocked if its template's purity reaches
    ``threshold``.  Null urls and urls without ``://`` have an empty host and path and are one template.
    Repeated rows are judged each; no rows give no rows.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(quoted(page_id).alias("page_id"), quoted(url).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, say = rule_of(F.col("host"), F.col("path"), rules)
    with Scratch(pages.sparkSession) as scratch:
        rows = scratch.keep(rows.select("page_id", "host", "path", rule.alias("rule"), say.alias("say"), shape(F.col("path")).alias("segs")), "urls")
        labelled = rows.select("host", "segs", F.when(F.col("say") == "block", 1).when(F.col("say") == "allow", 0).alias("bad"))
        tree = scratch.keep(templates(labelled, scratch, **how), "templates")
    tree = tree.select(F.col("host").alias("t_host"), F.col("segs").alias("t_segs"), "template", "purity")
    out = rows.join(tree, (F.col("host") == F.col("t_host")) & (F.col("segs") == F.col("t_segs")))
    verdict = F.coalesce("say", F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")
