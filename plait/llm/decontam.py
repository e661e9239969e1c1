"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Words are numbered; the automaton of all items is built on the driver from a benchmark of checked size
(larger ones are taken in blocks of items, each with an automaton and a pass of its own) and broadcast.
Documents stream through it and the longest matching length at each word tells which windows end there.
Only runs of words whose neighbouring pairs all occur in items enter the automaton; others cannot hold a
window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plait.llm.schemas import packed, quoted, slices, unpacked, with_fields
from plait.plans.staging import Scratch

WINDOW = 10
#: Words of items in an automaton, some 650 bytes each in the driver and in every Python worker.
BLOCK_WORDS = 100_000
_WORD = bytes.maketrans(bytes(range(128)), bytes(c if 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(128)))


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; maximal runs of digits, letters and whatever is not ASCII."""
    return text.translate(_WORD).split() if text else []


class ItemAutomaton:
    """Suffix automaton over the items' word numbers, with the items in which each state's windows occur."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        pairs = set()
        for _, ids in numbered:
            last = 0
            for c in ids:
                last = self._extend(last, c)
            pairs.update(zip(ids, ids[1:]))
        self.pairs = np.array(sorted(a * len(self.vocab) + b for a, b in pairs), np.int64)
        self.shortest = min((min(window, len(ids)) for _, ids in numbered), default=0)
        # windows of full length: items by state; shorter items: (length, item) by state
        self.full: list[set[str | None] | None] = [None] * len(self.link)
        self.short: list[list[tuple[int, str | None]] | None] = [None] * len(self.link)
        for name, ids in numbered:
            at = 0
            for c in ids:
                at = up = self.next[at][c]
                while up > 0 and self.length[up] >= window:
                    if self.full[up] is None:
                        self.full[up] = set()
                    if name in self.full[up]:
                        break
                    self.full[up].add(name)
                    up = self.link[up]
            if len(ids) < window:
                if self.short[at] is None:
                    self.short[at] = []
                self.short[at].append((len(ids), name))

    def _extend(self, last: int, c: int) -> int:
        """Add symbol ``c`` after the state ``last`` of the item so far; the new item's state."""
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last] and length[nxt[last][c]] == length[last] + 1:
            return nxt[last][c]
        fresh = -1
        if c not in nxt[last]:
            fresh = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = fresh
            p = link[p]
        if p < 0:
            link[fresh] = 0
            return fresh
        q = nxt[p][c]
        if length[q] != length[p] + 1:
            copy = self._state(length[p] + 1, dict(nxt[q]))
            link[copy], link[q] = link[q], copy
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = copy
                p = link[p]
            q = copy
        if fresh < 0:
            return q
        link[fresh] = q
        return fresh

    def _state(self, length: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Spans of known words whose neighbouring pairs all occur in items, long enough for a window."""
        if not self.shortest or len(ids) < self.shortest:
            return
        code = ids[:-1] * len(self.vocab) + ids[1:]
        ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            ok &= self.pairs[at] == code
        else:
            ok[:] = False
        # a run goes on from a word to the next where their pair is known; every known word starts one
        begins = (ids >= 0) & ~np.concatenate(([False], ok))
        ends = (ids >= 0) & ~np.concatenate((ok, [False]))
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = last - first >= self.shortest
        yield from zip(first[long].tolist(), last[long].tolist())

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint ascending spans of hit words (end exclusive), and the items with occurring windows that have an id."""
        ids = np.fromiter(map(self.vocab.get, words, [-1] * len(words)), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for first, last in self.runs(ids):
            state = matched = 0
            for i, c in enumerate(ids[first:last].tolist(), first + 1):
                while state and c not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                if c in nxt[state]:
                    state = nxt[state][c]
                    matched += 1
                longest, up = 0, state
                while up > 0 and length[up] >= self.shortest:
                    if matched >= window and length[up] >= window and length[link[up]] < window:
                        longest = window
                        items |= self.full[up] or set()
                    for n, name in self.short[up] or ():
                        if n <= matched:
                            longest = max(longest, n)
                            items.add(name)
                    up = link[up]
                if longest:
                    start = i - longest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, items - {None}


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of about ``block_words`` words, so that neither driver nor broadcast grows with the benchmark."""
    held, n = [], 0
    rows = benchmark.select(quoted(item_id).cast("string").alias("i"), quoted(text).cast("string").cast("binary").alias("t")).where("t is not null")
    for name, body in rows.toLocalIterator():
        words = words_of(bytes(body))
        if words:
            held.append((name, words))
            n += len(words)
        if n >= block_words:
            yield held
            held, n = [], 0
    if held:
        yield held


def scan(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, finish=None, finished: StructType | None = None) -> DataFrame:
    """``keys``, ``n_words``, ``spans`` (hit words, end exclusive) and ``items`` (as strings, ascending) of every row.

    Null and empty texts have no words; items without words are ignored; the windows of an item without an id
    hit, and it is in no list of items; an empty benchmark hits nothing; repeated rows stay; no rows give none.
    ``finish`` makes batches of the schema ``finished`` out of these, in the same Python worker where it can.
    """
    spark = docs.sparkSession
    # positions in place of names, which may be those of the results
    own = [f"k{i}" for i in range(len(keys))]
    source = docs.select(*[quoted(k).alias(o) for k, o in zip(keys, own)], quoted(text).cast("string").cast("binary").alias("t"))
    schema = with_fields(source, own, n_words="long", spans="array<struct<s:long,e:long>>", items="array<string>")
    span_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    named = [*[F.col(o).alias(k) for k, o in zip(keys, own)], "n_words", "spans", "items"]

    def passed(block: list[tuple[str | None, list[bytes]]], rows: DataFrame, schema: StructType, last: bool = False) -> DataFrame:
        shared, names = spark.sparkContext.broadcast(ItemAutomaton(block, window)), schema.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                n, spans, items = [], [], []
                for body in batch.column(batch.num_columns - 1):
                    words = words_of(body.as_py())
                    hit, found = shared.value.scan(words)
                    n.append(len(words))
                    spans.append([{"s": s, "e": e} for s, e in hit])
                    items.append(sorted(found))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))], names)

        if last and finish:
            return rows.mapInArrow(lambda batches: finish(run(batches)), finished)
        return rows.mapInArrow(run, schema)

    blocks = _blocks(benchmark, item_id, item_text, block_words)
    one = next(blocks, [])
    two = next(blocks, None)
    if two is None:
        out = passed(one, source, schema, last=True)
        return out if finish else out.select(*named)
    # a benchmark of several blocks: each pass gives spans and items by row number, which then meet their rows once
    with Scratch(spark) as scratch:
        source = scratch.keep(source.withColumn("row", F.monotonically_increasing_id()), "rows")
        lean, parts = source.select("row", "t"), None
        fields = with_fields(lean, ["row"], n_words="long", spans="array<struct<s:long,e:long>>", items="array<string>")
        for block in (b for group in ([one, two], blocks) for b in group):
            part = scratch.stage(passed(block, lean, fields), "pass")
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                          F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merged = scratch.keep(merged, "merged")
    joined = F.expr("""aggregate(spans, cast(array() as array<struct<s:bigint,e:bigint>>), (acc, x) ->
        case when size(acc) > 0 and element_at(acc, -1).e >= x.s
             then concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, x.e))))
             else concat(acc, array(x)) end)""")
    out = source.select("row", *own).join(merged.withColumn("spans", joined), "row").drop("row")
    return out.mapInArrow(finish, finished) if finish else out.select(*named)


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256 of the item ids joined by commas, contaminated.

    Nulls, repeated rows and no rows are as in ``scan``.
    """
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["e"] - s["s"])
    rows = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("t"))
    return scan(rows, benchmark, ["id"], "t", **how).select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and what stands between them."""
    plain, out, kept, word, at = text.translate(_WORD), [], 0, 0, 0
    for first, last in spans:
        start = end = at
        while word < last:
            while plain[at] == 32:
                at += 1
            if word == first:
                start = at
            end = plain.find(b" ", at)
            at = end = len(plain) if end < 0 else end
            word += 1
        out.append(text[kept:start])
        kept = end
    return b"".join([*out, text[kept:]])


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
           least_span: int = 1, most_cover: float = 0.5, block_words: int = BLOCK_WORDS, n_chars: str | None = "n_chars") -> DataFrame:
    """Filter: hit spans of ``least_span`` words or more leave the text; rows with over ``most_cover`` of their words hit leave.

    Columns stay those of ``docs``; ``n_chars``, if it is a column, follows the new text.  Rows without a hit,
    null and empty texts among them, are unchanged; repeated rows are treated each; no rows give no rows.
    """
    rows = packed(docs, text)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n, spans = (batch.column(i).to_pylist() for i in (1, 2, 3))
            keep = []
            for i, (hits, total) in enumerate(zip(spans, n)):
                keep.append(sum(s["e"] - s["s"] for s in hits) <= most_cover * total)
                long = [(s["s"], s["e"]) for s in hits if s["e"] - s["s"] >= least_span]
                if long and keep[-1]:
                    texts[i] = cut_spans(texts[i].encode(), long).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["rest", "text"]).filter(pa.array(keep, pa.bool_()))

    out = scan(rows, benchmark, ["rest", "text"], "text", item_id, item_text, window, block_words, finish, rows.schema).select(*unpacked(docs, text))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.char_length(quoted(text)).cast(docs.schema[n_chars].dataType))
    return out


def sha256_of(items: list[str]) -> str:
    """The digest that ``report`` gives for these item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
