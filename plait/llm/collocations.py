"""Phrase collocations: counts of all frequent phrases in arrays addressed by a minimal perfect hash.

Texts become chunks of one language: a vocabulary and the words by number, with a mark between pieces.
A phrase's key is 128 bits made of the language and the words' hashes.  Candidates grow Apriori-safe: a
phrase can be frequent only if all phrases inside it are, so each length is looked at only where the shorter ones
were heavy.  What is heavy is held in one bitmap of ``1 << BITS`` bits at most, by sums over 40 bits of the key; phrases that share
a bit or a sum can make a light one pass, never a heavy one fail.

One pass counts the candidates: a task adds up its chunks and sends arrays of keys, counts and first chunks by ranges of the
keys, and each range keeps what is frequent.  So the passes over the corpus don't grow with the candidates.
The frequent phrases are cut into blocks of bounded size, each with a minimal perfect hash and its keys in slot order.  Per
block one pass over the chunks looks up every phrase, verifies it by the stored key, and takes each
frequent phrase's words from its first chunk, so each is written once.  A pass costs a block: 2,097,152 phrases
are 32 MB of keys and as much of counts and chunks in each task.  Cuts are read by slot from the same arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.schemas import quoted, slices
from plait.plans.staging import Scratch, shuffles_dropped

#: Words of a chunk, at least; words held by a task that has many languages; phrases up to so many words.
CHUNK, HELD, LONGEST = 1 << 18, 1 << 20, 4
#: Bits of the bitmap of heavy phrases, 16 MB; words whose sums are added in one task; phrases of a block; texts sent as one batch.
BITS, RANGE, BLOCK, SLICE = 27, 1 << 21, 1 << 21, 1 << 14
#: Sums or keys that a task adds up over its chunks before it sends them.
SEEN = 1 << 20
BREAK = b"\xff"
_COLUMNS = ["lang", "words", "ids", "sizes", "chunk"]
_LOWER = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Vocabulary(dict):
    """Words by number; 0 is the mark between pieces."""

    def __init__(self):
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs(lang, text)`` → (lang, n, words, ids, sizes, chunk): n the number of words, the vocabulary and the words by number compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Vocabulary, list]] = {}
        sizes: dict[str, int] = {}

        def made(lang: str) -> pa.RecordBatch:
            words, parts = held.pop(lang)
            del sizes[lang]
            ids = np.concatenate(parts)
            both = [b" ".join(words), np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes()]  # no word has a blank in it; bytes of one place together
            columns = [pa.array([lang]), pa.array([int((ids > 0).sum())], pa.int64()), *[pa.array([pa.compress(x, "zstd", asbytes=True)], pa.binary()) for x in both]]
            return pa.RecordBatch.from_arrays([*columns, pa.array([[len(x) for x in both]], pa.list_(pa.int64()))], ["lang", "n", *_COLUMNS[1:4]])

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, parts = held.setdefault(lang, (_Vocabulary(), []))
                found = text.as_py().encode().translate(_LOWER).replace(BREAK, b" \xff ").split()
                found.append(BREAK)
                parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                sizes[lang] = sizes.get(lang, 0) + len(found)
                if sizes[lang] >= CHUNK:
                    yield made(lang)
                elif sum(sizes.values()) >= HELD:
                    yield from map(made, list(held))
        yield from map(made, list(held))

    return scratch.stage(docs.mapInArrow(run, "lang string, n bigint, words binary, ids binary, sizes array<bigint>").withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of each number; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _longer(keys: tuple[np.ndarray, ...], words: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Keys of phrases that go on with one more word."""
    return tuple(_mixed(k * odd + w) for k, odd, w in zip(keys, _ODD, words))


def _starts(lang: str, words: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Keys of phrases of one word."""
    return _longer(tuple(np.full(len(w), h[0], np.uint64) for w, h in zip(words, _hashes([lang.encode()]))), words)


class Heavy:
    """The bitmap of phrases that may be frequent, and how many words long those are that it knows."""

    def __init__(self, bits: np.ndarray | None = None, known: int = 0):
        self.bits, self.known = bits, known

    def has(self, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        at = (keys[0] >> np.uint64(24)) & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def joined(self, other: np.ndarray, known: int) -> Heavy:
        return Heavy(other if self.bits is None else self.bits | other, known)


def _phrases(row: dict, heavy: Heavy, longest: int = LONGEST):
    """(length, words, numbers of the words, places, keys) of all phrases of a chunk that may be frequent."""
    ids, words = row["ids"], row["words"]
    hashes = _hashes(words)
    keys = _starts(row["lang"], hashes)
    ok = np.arange(len(words)) > 0
    if heavy.known:
        ok &= heavy.has(keys)
    keys, ok = tuple(k[ids] for k in keys), ok[ids]
    at = np.flatnonzero(ok)
    yield 1, words, ids, at, tuple(k[at] for k in keys)
    for n in range(2, longest + 1):
        ok = ok[:-1] & ok[1:]
        at = np.flatnonzero(ok)
        found = _longer(tuple(k[at] for k in keys), tuple(h[ids[at + n - 1]] for h in hashes))
        if n <= heavy.known:
            good = heavy.has(found)
            ok[at[~good]] = False
            at, found = at[good], tuple(k[good] for k in found)
        keys = tuple(np.zeros(len(ok), np.uint64) for _ in keys)
        for k, f in zip(keys, found):
            k[at] = f
        yield n, words, ids, at, found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            sizes = batch.column("sizes")[k].as_py()
            words, ids = (pa.decompress(batch.column(c)[k].as_buffer(), n, "zstd", asbytes=True) for c, n in zip(("words", "ids"), sizes))
            yield {"lang": batch.column("lang")[k].as_py(), "chunk": batch.column("chunk")[k].as_py(), "words": words.split(b" "), "ids": np.frombuffer(ids, np.uint8).reshape(4, -1).T.copy().view(np.int32).reshape(-1)}


def _planes(x: np.ndarray) -> bytes:
    """An array compressed, the bytes of one place of all its numbers side by side."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), "zstd", asbytes=True)


def _numbers(column: pa.ChunkedArray, sizes: list[int], kind: type) -> np.ndarray:
    """The arrays of ``_planes`` one after another."""
    wide = np.dtype(kind).itemsize
    made = [np.frombuffer(pa.decompress(x.as_buffer(), n * wide, "zstd"), np.uint8).reshape(wide, n).T for x, n in zip(column, sizes)]
    return np.ascontiguousarray(np.concatenate(made)).view(kind).reshape(-1)


def _ranges(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """An order by parts, the parts there are, and where each begins and ends in the order."""
    order = np.argsort(parts, kind="stable")
    found, starts = np.unique(parts[order], return_index=True)
    return order, found.astype(np.int32), list(zip(starts.tolist(), [*starts[1:].tolist(), len(parts)]))


def _added_up(held: list[tuple[np.ndarray, ...]], add) -> Iterator[tuple[np.ndarray, ...]]:
    """What is to be sent of ``held``, tuples of arrays with a row for each thing; what adds up well stays until there is more of it."""
    if sum(len(x[0]) for x in held) >= SEEN:
        whole = add(*map(np.concatenate, zip(*held)))
        held[:] = [whole]
        if 2 * len(whole[0]) > SEEN:
            held.clear()
            yield whole


def _sums(sums: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each sum once, in order, with its times added."""
    order = np.argsort(sums)
    sums, times = sums[order], times[order]
    starts = np.flatnonzero(np.concatenate([[True], sums[1:] != sums[:-1]])[: len(sums)])
    return sums[starts], np.add.reduceat(times, starts) if len(starts) else times


def _bits(words: int) -> int:
    """How many bits number the bitmap's places: as many places as words, ``1 << BITS`` at most."""
    return min(BITS, max(16, math.ceil(math.log2(max(words, 1)))))


def _sieved(chunks: DataFrame, heavy: Heavy, first: int, last: int, least: int, words: int) -> Heavy:
    """``heavy`` with what is heavy among phrases of ``first`` to ``last`` words.

    A task's sums travel as arrays, one for each range of the bitmap; there are so many ranges that one holds
    ``RANGE`` of the ``words`` words, and each becomes its part of the bitmap.
    """
    shared, bits = chunks.sparkSession.sparkContext.broadcast(heavy), _bits(words)
    low = max(bits - 20, bits - math.ceil(math.log2(max(1, words / RANGE))), 3) if words > RANGE else bits
    mask, inner = np.int64((1 << bits) - 1), np.int64((1 << low) - 1)

    def sent(sums: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        order, found, cut = _ranges((sums & mask) >> low)
        # the bits that tell the range are the same in all of it
        sums, times = ((sums >> bits << low) | (sums & inner))[order], times[order].astype(np.int32)
        held = [pa.array([_planes(x) for x in made], pa.binary()) for made in ([np.diff(sums[s:e], prepend=0) for s, e in cut], [times[s:e] for s, e in cut])]
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array([e - s for s, e in cut], pa.int32()), *held], ["part", "size", "sums", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for row in _rows(batches):
            for n, _, _, _, keys in _phrases(row, shared.value, last):
                if n >= first and len(keys[0]):
                    held.append(np.unique((keys[0] >> np.uint64(24)).astype(np.int64), return_counts=True))
                    yield from (sent(*x) for x in _added_up(held, _sums))
        if held:
            yield sent(*_sums(*map(np.concatenate, zip(*held))))

    def added(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_pylist()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        sums = _numbers(table.column("sums"), sizes, np.int64)
        for s, e in zip(starts.tolist(), starts[1:].tolist()):
            sums[s:e] = np.cumsum(sums[s:e])
        sums, times = _sums(sums, _numbers(table.column("times"), sizes, np.int32).astype(np.int64))
        bits = np.zeros(1 << low, bool)
        bits[sums[times >= least] & inner] = True
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    parts = chunks.select(*_COLUMNS).mapInArrow(run, "part int, size int, sums binary, times binary")
    found = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.groupBy("part").applyInArrow(lambda t: added(t), "part int, bits binary").collect():  # the bitmap, 16 MB at most
        found[r.part << (low - 3) : (r.part + 1) << (low - 3)] = np.frombuffer(r.bits, np.uint8)
    shared.destroy()
    return heavy.joined(found, last)


def _part(b: np.ndarray, parts: int) -> np.ndarray:
    """The part of the candidates to which keys belong."""
    return ((b >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _tally(a: np.ndarray, b: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, in order, with its counts added and the least of its chunks."""
    order = np.argsort(a)
    new = np.concatenate([[True], a[order][1:] != a[order][:-1]])[: len(a)]
    if (b[order][1:] != b[order][:-1])[~new[1:]].any():  # two keys with one first half
        order = np.lexsort((b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[: len(a)]
    starts = np.flatnonzero(new)
    if not len(starts):
        return a, b, counts, firsts
    return a[order][starts], b[order][starts], np.add.reduceat(counts[order], starts), np.minimum.reduceat(firsts[order], starts)


def _frequent(chunks: DataFrame, heavy, parts: int, least: int) -> DataFrame:
    """(part, n, keys, counts, firsts): all phrases that occur ``least`` times, with their first chunks, as arrays; as many parts as ``parts``."""
    kinds = {"a": np.uint64, "b": np.uint64, "counts": np.int64, "firsts": np.int64}

    def sent(*made: np.ndarray) -> pa.RecordBatch:
        order, found, cut = _ranges(_part(made[1], parts))
        columns = [pa.array([_planes(x[order][s:e]) for s, e in cut], pa.binary()) for x in made]
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array([e - s for s, e in cut], pa.int32()), *columns], ["part", "size", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for row in _rows(batches):
            for *_, (a, b) in _phrases(row, heavy.value):
                held.append(_tally(a, b, np.ones(len(a), np.int64), np.full(len(a), row["chunk"], np.int64)))
                yield from (sent(*x) for x in _added_up(held, _tally))
        if any(len(x[0]) for x in held):
            yield sent(*_tally(*map(np.concatenate, zip(*held))))

    def joined(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_pylist()
        a, b, counts, firsts = _tally(*(_numbers(table.column(c), sizes, kind) for c, kind in kinds.items()))
        often = counts >= least
        made = [np.concatenate([a[often], b[often]]), counts[often], firsts[often]]
        out = pa.table({"part": table.column("part").slice(0, 1), "n": pa.array([len(made[1])], pa.int64()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("keys", "counts", "firsts"), made)}})
        return out if len(made[1]) else out.slice(0, 0)

    tallied = chunks.select(*_COLUMNS).mapInArrow(run, "part int, size int, a binary, b binary, counts binary, firsts binary")
    return tallied.groupBy("part").applyInArrow(lambda t: joined(t), "part int, n bigint, keys binary, counts binary, firsts binary")


def _keys(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of all keys in arrays of ``_frequent``."""
    made = [np.frombuffer(x.as_buffer(), np.uint64).reshape(2, -1) for x in column]
    both = np.concatenate(made, axis=1) if made else np.zeros((2, 0), np.uint64)
    return both[0], both[1]


class PerfectHash:
    """A minimal perfect hash of 128-bit keys: levels of bits, a key's slot is the rank of the first bit that it has alone."""

    def __init__(self, a: np.ndarray, b: np.ndarray, most: int = 200):
        self.levels: list[np.ndarray] = []
        left, slots, base = np.arange(len(a)), np.empty(len(a), np.int64), 0
        while len(left):
            if len(self.levels) == most:
                raise ValueError("two candidates have the same key")
            size = 2 * len(left) + 1
            at = self._at(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            good = alone[at]
            ranks = np.cumsum(alone)
            slots[left[good]] = base + ranks[at[good]] - 1
            self.levels.append(np.packbits(alone, bitorder="little"))
            base += int(ranks[-1])
            left = left[~good]
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slots], self.b[slots] = a, b
        self.sizes = self.ranks = None

    @staticmethod
    def _at(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mixed(a * np.uint64(2 * level + 3) + b) % np.uint64(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where the stored key is another."""
        if self.ranks is None:
            self.ranks, self.sizes, base, left = [], [], 0, len(self.a)
            for bits in self.levels:
                ranks = base + np.cumsum(np.unpackbits(bits, bitorder="little"), dtype=np.int32)
                self.sizes.append(2 * left + 1)
                left -= int(ranks[-1]) - base
                base = int(ranks[-1])
                self.ranks.append(ranks)
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (bits, ranks, size) in enumerate(zip(self.levels, self.ranks, self.sizes)):
            at = self._at(a[left], b[left], level, size)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            out[left[hit]] = ranks[at[hit]] - 1
            left = left[~hit]
        known = np.flatnonzero(out >= 0)
        wrong = (self.a[out[known]] != a[known]) | (self.b[out[known]] != b[known])
        out[known[wrong]] = -1
        return out


class Block:
    """A block of the frequent phrases: which parts it has, their perfect hash, and counts and first chunks by slot."""

    def __init__(self, frequent: DataFrame, number: int, blocks: int, parts: int):
        self.number, self.blocks, self.parts = number, blocks, parts
        own = frequent.where(F.pmod("part", F.lit(blocks)) == number).select("keys", "counts", "firsts").toArrow()  # ``BLOCK`` keys or so
        keys = _keys(own.column("keys"))
        self.known = PerfectHash(*keys)
        order = np.argsort(self.known.slots(*keys))
        self.known.ranks = self.known.sizes = None  # each task makes its own
        self.counts, self.firsts = (np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x.as_buffer(), np.int64) for x in own.column(c)]])[order] for c in ("counts", "firsts"))

    def slots(self, keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are in the block, and their slots."""
        own = np.flatnonzero(_part(keys[1], self.parts) % self.blocks == self.number) if self.blocks > 1 else np.arange(len(keys[1]))
        slots = self.known.slots(*(k[own] for k in keys))
        return own[slots >= 0], slots[slots >= 0]


def _texts(chunks: DataFrame, heavy, block) -> DataFrame:
    """(lang, words, phrase) of the block's phrases of several words, each from its first chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            for n, words, ids, at, keys in _phrases(row, heavy.value):
                own, slots = block.value.slots(keys) if n > 1 else (at[:0], at[:0])
                mine = block.value.firsts[slots] == row["chunk"]
                _, first = np.unique(slots[mine], return_index=True)
                places = at[own[mine][first]].tolist()
                for k in range(0, len(places), SLICE):
                    texts = [b" ".join([words[w] for w in ids[s : s + n].tolist()]) for s in places[k : k + SLICE]]
                    made = [pa.array([row["lang"]] * len(texts), pa.string()), pa.array([n] * len(texts), pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(made, ["lang", "words", "phrase"])

    return chunks.select(*_COLUMNS).mapInArrow(run, "lang string, words int, phrase string")


def _read(phrases: DataFrame, block) -> DataFrame:
    """``phrases`` with ``f``, the counts of the phrase, its beginnings and its ends, where these are in the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [list(x) for x in batch.column(3).to_pylist()]
            groups: dict[tuple, list] = {}
            for k, (lang, n, phrase) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                groups.setdefault((lang, n), []).append((k, phrase.encode().split(b" ")))
            for (lang, n), own in groups.items():
                words = [_hashes([phrase[w] for _, phrase in own]) for w in range(n)]
                spans = [(0, n)] + [s for cut in range(1, n) for s in ((0, cut), (cut, n))]
                for place, (first, last) in enumerate(spans):
                    keys = _starts(lang, words[first])
                    for w in range(first + 1, last):
                        keys = _longer(keys, words[w])
                    mine, slots = block.value.slots(keys)
                    for k, count in zip(mine.tolist(), block.value.counts[slots].tolist()):
                        f[own[k][0]][place] = count
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(f, pa.list_(pa.int64()))], ["lang", "words", "phrase", "f"])

    return phrases.mapInArrow(run, "lang string, words int, phrase string, f array<bigint>")


def counted(docs: DataFrame, scratch: Scratch, least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of 2 to 4 words that occur ``least`` times, and (lang, n).

    ``f`` is the phrase's count, then for each cut that of the words before it and of those after it.
    """
    spark = docs.sparkSession
    own = F.coalesce(quoted(lang).cast("string"), F.lit("und")), F.coalesce(quoted(text).cast("string"), F.lit(""))
    chunks = _chunks(docs.select(own[0].alias("lang"), own[1].alias("text")), scratch)
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    words, heavy = chunks.agg(F.sum("n")).first()[0] or 0, Heavy()
    for first, last in ((1, 1), (2, 2), (3, LONGEST)):
        heavy = _sieved(chunks, heavy, first, last, least, words)
    parts, kept = math.ceil(words / RANGE) or 1, []

    def share(value):
        kept.append(spark.sparkContext.broadcast(value))
        return kept[-1]

    heavy, phrases = share(heavy), None
    frequent = scratch.stage(_frequent(chunks, heavy, parts, least), "frequent")
    blocks = min(parts, math.ceil((frequent.agg(F.sum("n")).first()[0] or 0) / BLOCK) or 1)
    for k in range(blocks):
        block = share(Block(frequent, k, blocks, parts))
        texts = scratch.stage(_texts(chunks, heavy, block), "texts")
        phrases = texts if phrases is None else phrases.unionByName(texts)
    phrases = phrases.select("lang", "words", "phrase", F.array_repeat(F.lit(0).cast("long"), 2 * F.col("words") - 1).alias("f"))
    for k in range(blocks):
        block = block if blocks == 1 else share(Block(frequent, k, blocks, parts))
        phrases = scratch.stage(_read(phrases, block), "phrases")
    for shared in kept:  # all tables that read them are written
        shared.destroy()
    phrases = phrases.where(F.col("f")[0] >= least)
    return phrases, totals


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, inside: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` collocations.

    Texts are lower-cased (A-Z only), cut into pieces at ``.,;:!?`` and line ends and then into words at blanks and
    tabs; phrases of 2 to 4 words lie within pieces and count by language (null: ``und``) wherever they occur.
    With a = f(phrase) of ``least`` or more, a phrase is scored at the cut for which floor(2,000,000 a / (l + r))
    is least, the first of several.  Phrases within a longer one that has ``inside`` percent of their count go.
    ``n`` is the number of the language's words.  Null and empty texts have no words; repeated rows count each;
    order is by score and count, descending, then by the phrase's bytes; no rows give none.
    """
    with Scratch(docs.sparkSession) as scratch, shuffles_dropped(docs.sparkSession):
        phrases, totals = counted(docs, scratch, least, text, lang)
        phrases = scratch.keep(phrases, "phrases")
        totals = scratch.keep(totals, "totals")
    wide = lambda x: x.cast("decimal(38,0)")
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: F.array_join(F.slice(words, at, n), " "))))
    within = phrases.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("f")[0].alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    a = F.col("f")[0]
    left = phrases.join(within, ["lang", "phrase"], "left").where(F.coalesce(wide(F.col("longer")) * 100 < wide(a) * inside, F.lit(True)))
    l, r = (lambda k: F.get("f", 2 * k - 1)), (lambda k: F.get("f", 2 * k))
    score = lambda k: F.call_function("div", wide(a) * 2_000_000, wide(l(k)) + wide(r(k)))
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(score(k).alias("score"), k.alias("k"), l(k).alias("l"), r(k).alias("r")))
    best = left.select("lang", "phrase", a.alias("a"), F.array_min(cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
