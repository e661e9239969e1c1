"""Line dedup by winnowing over line hashes; DataFrame functions only.

A run of lines counts as repeated if it holds ``window_words`` words and the same lines stand somewhere
earlier.  A window is the shortest run from a line on with that many words, and the least of the hashes of
the shingles inside it (shortest runs of ``shingle_words`` words) is its fingerprint, so every repeated run
shares a selected fingerprint with its earlier copy.  Rows without a fingerprint that occurs twice leave here.

Matches are extended both ways by the same rule from every line of the rest: the shortest run with
``window_words`` words that starts there, and the one that ends there.  A line of a repeated run is always
in one of those of the run (from the line on, up to it, or from the run's start over it), so comparing each
with its first occurrence finds all repeated runs, whichever earlier row they are shared with, and makes two
rows a line however often one is repeated.  Runs compare by 96 bits of hash and their number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.schemas import quoted
from plait.plans.staging import Scratch

#: Lines whose words are summed at a time; runs have no limit.
LOOK = 64
#: Any white space of Unicode but line feeds, which end lines.
BLANK = r"[\s\x85   -     　]+"

#: The characters of ``BLANK``, which don't count at the ends of a line.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _words(line: Column) -> Column:
    """Words of a line, told by white space of any kind; 0 for a blank one."""
    return F.size(F.filter(F.split(line, BLANK), lambda x: x != ""))


def _let(value: Column, use) -> Column:
    """``use`` of the value, worked out once; as a column of its own it would be put into every lambda and worked out for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda n, y: n + y)


def _with_before(w: Column, use) -> Column:
    """``use`` of the words in front of each line: sums of blocks of lines, then sums within the block."""
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(w) - 1) / LOOK), F.lit(0)).cast("int"))
    sums = F.transform(blocks, lambda b: _total(F.slice(w, b * LOOK + 1, F.lit(LOOK))))
    inside = lambda i: _total(F.slice(w, i - i % LOOK + 1, i % LOOK))
    return _let(sums, lambda s: _let(F.transform(blocks, lambda b: _total(F.slice(s, F.lit(1), b))), lambda fronts: _let(
        F.transform(w, lambda _, i: F.get(fronts, F.floor(i / LOOK).cast("int")) + inside(i)), use)))


def _prepared(text: Column, shingle_words: int, window_words: int) -> Column:
    """Struct of ``selected``, hashes of fingerprints, and ``runs``, from a text that is not null.

    Lines here are those with words.  A line's hash holds the number of blank lines before it, but for the first of a run; a
    run that has blank lines at an end is told by the run without them and their number.  So a window has as
    many lines as words at most, however many blank lines stand between.
    """
    known = lambda x: x.isNotNull()

    def made(at: Column, h: Column, linked: Column, w: Column, before: Column, places: Column, n: Column) -> Column:
        def end(i: Column, words: int) -> Column:  # of the shortest run from line i, or null
            return F.get(places, F.get(before, i) + (words - 1)) + 1

        def start(i: Column) -> Column:  # of the shortest run that ends with line i, or null
            return _let(F.get(before, i) + F.get(w, i) - window_words, lambda last: F.when(last >= 0, F.get(places, last)))

        def lines(s: Column, e: Column) -> Column:
            return F.concat(F.array(F.get(h, s)), F.slice(linked, s + 2, e - s - 1))

        def shingle(_, i: Column) -> Column:
            return _let(end(i, shingle_words), lambda e: F.when(e.isNotNull(), F.struct(F.xxhash64(lines(i, e)).alias("hash"), i.alias("pos"), e.alias("end"))))

        def run(s: Column, e: Column) -> Column:
            first = F.get(at, s)
            return F.when(s.isNotNull() & e.isNotNull(), _let(lines(s, e), lambda x: F.struct(
                F.xxhash64(x).alias("hash"), F.hash(x).alias("check"), first.alias("s"), (F.get(at, e - 1) - first + 1).alias("lines"))))

        def wider(r: Column, blanks: Column, leading: bool) -> Column:  # the run with each number of blank lines at one end
            def one(k: Column) -> Column:
                more = k if leading else -k
                return F.when(k == 0, r).otherwise(F.struct(F.xxhash64(r["hash"], more).alias("hash"), F.hash(r["check"], more).alias("check"), (r["s"] - k if leading else r["s"]).alias("s"), (r["lines"] + k).alias("lines")))
            return F.when(r.isNotNull() & (blanks == 0), F.array(r)).when(r.isNotNull(), F.transform(F.sequence(F.lit(0), blanks), one)).otherwise(F.array().cast("array<struct<hash:bigint,check:int,s:int,lines:int>>"))

        def chosen(shingles: Column) -> Column:
            def least(_, i: Column) -> Column:
                return _let(end(i, window_words), lambda e: F.when(e.isNotNull(), F.array_min(F.filter(F.slice(shingles, i + 1, e - i), lambda x: x["end"] <= e))))
            # the least of windows that move on never moves back, so equal ones are neighbours
            return _let(F.filter(F.transform(w, least), known), lambda found: F.transform(
                F.filter(found, lambda x, i: (i == 0) | (F.get(found, i - 1)["pos"] != x["pos"])), lambda x: x["hash"]))

        blanks_before = lambda i: F.get(at, i) - F.coalesce(F.get(at, i - 1), F.lit(-1)) - 1
        blanks_after = lambda i: F.coalesce(F.get(at, i + 1), n) - F.get(at, i) - 1
        on = F.flatten(F.transform(w, lambda _, i: _let(_let(end(i, window_words), lambda e: run(i, e)), lambda r: wider(r, blanks_before(i), True))))
        # a run that is shortest from both ends is in the first list already
        twice = lambda s, i: F.coalesce(end(s, window_words) == i + 1, F.lit(False))
        back = F.flatten(F.transform(w, lambda _, i: _let(start(i), lambda s: _let(run(s, i + 1), lambda r: _let(wider(r, blanks_after(i), False), lambda x: F.when(
            s.isNotNull() & twice(s, i), F.slice(x, F.lit(2), F.size(x))).otherwise(x))))))
        return F.struct(_let(F.transform(w, shingle), chosen).alias("selected"), F.concat(on, back).alias("runs"))

    def of_words(at: Column, h: Column, w: Column, n: Column) -> Column:
        places = F.flatten(F.transform(w, lambda n, i: F.array_repeat(i, n)))
        linked = F.transform(h, lambda x, i: F.xxhash64(x, F.get(at, i) - F.coalesce(F.get(at, i - 1), F.lit(-1))))
        return _with_before(w, lambda before: _let(places, lambda p: _let(linked, lambda x: made(at, h, x, w, before, p, n))))

    def of_lines(lines: Column, words: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(words, i) > 0)
        return _let(at, lambda at: _let(F.transform(at, lambda i: F.xxhash64(F.trim(F.get(lines, i), F.lit(BLANKS)))), lambda h: _let(
            F.transform(at, lambda i: F.get(words, i)), lambda w: of_words(at, h, w, F.size(lines)))))

    return _let(F.split(text, "\n", -1), lambda lines: _let(F.transform(lines, _words), lambda words: of_lines(lines, words)))


def _repeated(base: DataFrame, scratch: Scratch) -> DataFrame:
    """``base(row, key, selected, runs)`` → row and ``gone``, the lines to delete, for rows that have any.

    The joins are of one kind at every size: what they hold grows with the corpus.
    """
    prints = base.select("row", F.explode("selected").alias("hash"))
    common = scratch.stage(prints.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "common")
    met = scratch.stage(prints.join(common.hint("merge"), "hash").select("row").distinct(), "met")
    posts = base.join(met.hint("merge"), "row", "left_semi").select("row", "key", F.inline("runs")).select(
        "hash", "check", "lines", F.struct("key", "row", "s").alias("at"))
    same = ["hash", "check", "lines"]
    first = scratch.stage(posts.groupBy(*same).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    later = posts.join(first.hint("merge"), same).where(F.col("at") != F.col("first"))
    # what no run before it in the text has deleted already, so that a line comes once however many runs it is in
    spans = later.select(F.col("at.row").alias("row"), F.col("at.s").alias("s"), (F.col("at.s") + F.col("lines") - 1).alias("e"))
    so_far = F.max("e").over(Window.partitionBy("row").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("s", F.greatest("s", so_far + 1)).where("s <= e").select("row", F.sequence("s", "e").alias("lines"))
    return new.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("gone"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 10, window_words: int = 20) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (line numbers from 0, joined by commas) and the text that stays, of every row.

    A line goes if it is in a run of ``window_words`` words or more that also stands earlier: in a row of a
    smaller id (null ids last), or at an earlier place of the text, where the two may overlap.  Lines compare
    without blanks at their ends.  ``shingle_words`` (at most ``window_words``) sets how many words a
    fingerprint spans, never the result.  A null text has no lines and stays null; an empty one is one line;
    repeated rows are copies of one another, of which one stays whole; no rows give no rows.
    """
    if shingle_words > window_words:
        raise ValueError("a shingle has at most the words of a window")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), quoted(doc_id).alias("doc_id"), quoted(text).cast("string").alias("text"))
    base = rows.withColumn("made", F.when(F.col("text").isNotNull(), _prepared(F.col("text"), shingle_words, window_words)))
    with Scratch(docs.sparkSession) as scratch:
        base = scratch.keep(base.select("row", "doc_id", "text", "made.selected", "made.runs"), "lines")
        keyed = base.select("row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("key"), "selected", "runs")
        gone = scratch.keep(_repeated(keyed, scratch), "gone")
    # one plan at every size: a broadcast of the deletions would grow with the corpus
    out = base.select("row", "doc_id", "text").join(gone.hint("merge"), "row", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    lines = F.split(F.col("text"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    kept = F.when(F.size("gone") > 0, F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")).otherwise(F.col("text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size(lines), F.lit(0))).cast("long")
    deleted = F.array_join(F.col("gone").cast("array<string>"), ",")
    return out.select("doc_id", n_lines.alias("n_lines"), F.size("gone").cast("long").alias("n_deleted"), deleted.alias("deleted"), kept.alias("text"))
