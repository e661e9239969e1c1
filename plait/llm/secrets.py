"""Secret scan with corpus-wide ownership frequency.

All of it is DataFrame functions.  One scan finds the matches of each kind; where a match starts follows
from the lengths of the texts between matches, summed in order.  Candidates are long mixed tokens.  The
hashes of all tokens, those of the base spans too, are counted by distinct owner and repository in two steps
with map-side partials: a token that few owners and repositories have looks live, one that many share is an
example that was copied.  Live candidates are added as spans of their own; base spans stay, with their class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.schemas import quoted
from plait.plans.staging import Scratch

#: Kind, pattern, group that must be long enough, its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
CANDIDATE = ("live", r"[A-Za-z0-9+/_-]{20,}", 0, 20)


def _matches(text: Column, kind: str, pattern: str, group: int, least: int, order: int) -> Column:
    """Structs of a kind's matches in order: length before it since the last match, its own, whether it counts, its token."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    token = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), whole.alias("m"), token.alias("t"))
    full = F.filter(zipped, lambda x: x["m"].isNotNull())
    return F.transform(full, lambda x, i: F.struct(F.lit(order).alias("o"), F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["g"]).cast("long").alias("gap"),
                                                 F.char_length(x["m"]).cast("long").alias("len"), (F.char_length(x["t"]) >= least).alias("ok"), x["t"].alias("token")))


def _found(text: Column) -> Column:
    """All kinds' matches; a cheap test spares most rows and kinds the rest."""
    tests = (r"(?i)(password|passwd|secret|token|api_?key)", "AKIA", "[0-9a-f]{24}", CANDIDATE[1])
    each = [F.when(text.rlike(test), _matches(text, *kind, order)) for order, (kind, test) in enumerate(zip((*BASE, CANDIDATE), tests))]
    none = F.array().cast("array<struct<o:int,kind:string,i:int,gap:bigint,len:bigint,ok:boolean,token:string>>")
    return F.concat(*[F.coalesce(e, none) for e in each])


def _listed(spans: Column, *fields: str) -> Column:
    """The fields of each span joined by colons, the spans, sorted by start and then kind in order, by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", *[s[f].cast("string") for f in fields])), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", most_owners: int = 1, most_repositories: int = 3) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and classes of every row.

    A token is ``live`` if at most ``most_owners`` owners (null is one) and ``most_repositories`` documents have it,
    as a candidate or in a base span, else ``copied``; ``classes`` has class:owners:documents of each of ``spans``.
    A candidate is added as ``live`` if its token is, it has a letter and a digit, and no base span overlaps it.
    A null text is an empty one; repeated rows are scanned each and are one document; no rows give no rows.
    """
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    ordered = Window.partitionBy("row", "o").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_base = F.col("o") < len(BASE)
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), quoted(doc_id).alias("doc_id"), quoted(owner).cast("string").alias("owner"), _found(body).alias("found")), "found")
        hits = rows.where(F.size("found") > 0).select("row", "doc_id", "owner", F.inline("found"))
        spans = hits.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(ordered)).withColumn("start", F.col("end") - F.col("len"))
        spans = spans.where("ok").where(is_base | (F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]")))
        spans = scratch.stage(spans.select("row", "doc_id", "owner", "o", "kind", "start", "end", F.sha2("token", 256).alias("hash")), "spans")
        owners = spans.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("docs"))
        held = scratch.stage(owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("docs").alias("docs")), "owners")
        few = (F.col("owners") <= most_owners) & (F.col("docs") <= most_repositories)
        known = spans.join(held, "hash").withColumn("class", F.when(few, "live").otherwise("copied")).where(is_base | few)
        span = F.struct("start", "o", "kind", "end", "class", "owners", "docs")
        grouped = known.groupBy("row").agg(F.collect_list(F.when(is_base, span)).alias("base"), F.collect_list(F.when(~is_base, span)).alias("live"))
        clear = F.filter("live", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        grouped = scratch.keep(grouped.select("row", "base", F.concat("base", clear).alias("every")), "grouped")
    none = F.array().cast(grouped.schema["base"].dataType)
    out = rows.select("row", "doc_id").join(grouped, "row", "left").withColumn("base", F.coalesce("base", none)).withColumn("every", F.coalesce("every", none))
    counts = [F.size(F.filter("base", lambda s: s["o"] == k)).cast("long").alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)]  # noqa: B023
    place = ("kind", "start", "end")
    return out.select("doc_id", *counts, F.sha2(_listed(F.col("base"), *place), 256).alias("base_sha256"), _listed(F.col("every"), *place).alias("spans"),
                      _listed(F.col("every"), "class", "owners", "docs").alias("classes"))
