"""Chroma audio fingerprints of a media column.

A recording is mono 8-bit PCM (any bytes will do).  Frames become 12 pitch-class energies; the integral
image over frames and classes gives every filter in four look-ups; 16 filters of 2 bits each are packed
into a 32-bit integer per frame.  Recordings with the same fingerprints are one class.

Recordings that share fingerprints at one offset, all of them, are found by the fingerprints and what follows each at
which distance, so that many recordings may share a single value.  Each such alignment is verified by bit errors: in the best stretch of an overlap a print counts 4 less its wrong bits, and
one that repeats the print before it, as in silence, hum and steady tones, counts nothing if it is right.  A stretch must
hold ``least_votes`` prints and reach a score that ten right prints have and unrelated recordings don't: their
prints differ in 7 of 32 bits (noise) to 11 (melodies), and the best of 200 offsets of two has reached 17 so far.
Steady prints count like any others only where the stretch makes up two fifths of the shorter recording.
Recordings that align, directly or over others, are one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plait.llm.schemas import quoted, slices, with_fields
from plait.plans.components import connected_components
from plait.plans.staging import Scratch

#: Frames of 2,048 samples have bins of 3.9 Hz, which tell semitones apart from 110 Hz on.
RATE, FRAME, HOP, CLASSES = 8000, 2048, 256, 12
FILTERS, STEP = 16, 0.15
BLOCK = 1 << 10
#: Wrong bits of a print at which it counts nothing for an alignment, an eighth, and what a stretch must reach.
EVEN, ENOUGH = 4, 40
#: The share of the shorter recording from which on a stretch may be of steady prints.
STEADY = 0.4
#: Recordings of more prints meet others by single values, values of more places meet in tiles, and bytes of a hash.
LONG, TILE, WIDE = 2048, 1024, 5
#: Bytes of places that are taken at a time, and pairs of equal hashes.
TAKEN, PAIRS = 1 << 23, 1 << 21


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames), by rule: kinds in turn over shifting bands and widths."""
    out = []
    for k in range(FILTERS):
        high = 2 + 2 * (k % 5)
        out.append((k % 4, (5 * k) % (CLASSES - high + 1), high, 2 + 2 * (k // 4 % 2)))
    return out


WIDEST = max(f[3] for f in _filters())


def _pitch_classes() -> np.ndarray:
    """FFT bins × pitch classes: which class a bin's frequency belongs to."""
    bins = np.arange(14, FRAME // 2 + 1)  # from 55 Hz on
    which = np.round(12 * np.log2(bins * RATE / FRAME / 440.0)).astype(int) % CLASSES
    out = np.zeros((FRAME // 2 + 1, CLASSES), np.float32)
    out[bins, which] = 1
    return out


def chroma(signal: bytes | None) -> np.ndarray:
    """Frames × 12, centred ``HOP`` apart, each scaled to sum 1; beyond the signal's ends is silence, and an empty one has no frames."""
    if not signal:
        return np.zeros((0, CLASSES), np.float32)
    x = np.frombuffer(signal, np.uint8).astype(np.float32) - 128
    x = np.pad(x, (FRAME // 2, max(FRAME // 2, FRAME // 2 + (WIDEST - 1) * HOP - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, classes = np.hanning(FRAME).astype(np.float32), _pitch_classes()
    out = []
    for at in range(0, len(frames), BLOCK):
        spectrum = np.fft.rfft(frames[at : at + BLOCK] * window, axis=1)
        out.append((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ classes)
    out = np.concatenate(out)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-6)


def prints(image: np.ndarray) -> np.ndarray:
    """Packed fingerprints of a chroma image, one for each frame that all filters fit on."""
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, CLASSES + 1))
    total[1:, 1:] = image.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    def area(t: int, y: int, wide: int, high: int) -> np.ndarray:
        a, b = total[t : t + n], total[t + wide : t + wide + n]
        return b[:, y + high] - a[:, y + high] - b[:, y] + a[:, y]
    out = np.zeros(n, np.uint32)
    for kind, y, high, wide in _filters():
        whole = area(0, y, wide, high)
        if kind == 0:  # a band against all classes
            part, rest = whole, area(0, 0, wide, CLASSES) - whole
        elif kind == 1:  # its lower half against its upper
            part = area(0, y, wide, high // 2)
            rest = whole - part
        elif kind == 2:  # its earlier half against its later
            part = area(0, y, wide // 2, high)
            rest = whole - part
        else:  # two opposite quarters against the others
            part = area(0, y, wide // 2, high // 2) + area(wide // 2, y + high // 2, wide - wide // 2, high - high // 2)
            rest = whole - part
        value = np.log((0.01 + part) / (0.01 + rest))
        level = (value > -STEP).astype(np.uint32) + (value > 0) + (value > STEP)
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def numbered(values: np.ndarray) -> np.ndarray:
    """A print and how many equal ones come right before it as one 64-bit integer, so that a long constant stretch has many values."""
    at = np.arange(len(values))
    starts = np.maximum.accumulate(np.where(np.diff(values, prepend=values[:1] + 1) != 0, at, 0)) if len(values) else at
    return (values.astype(np.int64) << 32) | (at - starts)


def with_prints(media: DataFrame, keys: list[str], column: Column) -> DataFrame:
    """``keys`` and ``prints``, an array of fingerprints as signed 32-bit integers."""
    source = media.select(*[quoted(k) for k in keys], column.cast("binary").alias("__media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [prints(chroma(m.as_py())).view(np.int32) for m in batch.column(len(keys))]
            offsets = np.concatenate(([0], np.cumsum([len(m) for m in made]))).astype(np.int32)
            flat = np.concatenate(made) if made else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], [*keys, "prints"])

    return source.mapInArrow(run, with_fields(source, keys, prints="array<int>"))


def _fresh(prints: np.ndarray) -> np.ndarray:
    """Whether each print is of a sound that moves: unlike the one before, and unlike those half a frame and a frame before and after it."""
    out = np.concatenate(([True], prints[1:] != prints[:-1]))[: len(prints)]
    for away in (FRAME // HOP // 2, FRAME // HOP):
        if len(prints) > away:
            steady = np.bitwise_count(prints[away:].view(np.uint32) ^ prints[:-away].view(np.uint32)) <= EVEN
            out[away:] &= ~steady
            out[:-away] &= ~steady
    return out


def stretch(a: np.ndarray, b: np.ndarray, offset: int, steady: bool = False) -> tuple[int, int, int]:
    """Score, prints and wrong bits of the best stretch of ``a`` laid against ``b`` at ``offset``: the greatest sum of ``EVEN`` less wrong bits.

    Prints of a steady sound in either recording don't add to it, but with ``steady``.
    """
    low, high = max(0, offset), min(len(a), len(b) + offset)
    if high <= low:
        return 0, 0, 0
    x, y = a[low:high], b[low - offset : high - offset]
    wrong = np.bitwise_count(x.view(np.uint32) ^ y.view(np.uint32)).astype(np.int64)
    gain = EVEN - wrong
    if not steady:
        gain = np.where(_fresh(a)[low:high] & _fresh(b)[low - offset : high - offset], gain, np.minimum(gain, 0))
    total = np.concatenate(([0], np.cumsum(gain)))
    rise = total - np.minimum.accumulate(total)
    end = int(rise.argmax())
    start = int(total[: end + 1].argmin())
    return int(rise[end]), end - start, int(wrong[start:end].sum())


def votes(a: np.ndarray, b: np.ndarray, offset: int) -> int:
    """How many values of ``a`` laid against ``b`` at ``offset`` are equal."""
    low, high = max(0, offset), min(len(a), len(b) + offset)
    return int((a[low:high] == b[low - offset : high - offset]).sum()) if high > low else 0


def aligned(a: np.ndarray, b: np.ndarray, offset: int, least_votes: int) -> tuple[int, int, int] | None:
    """The stretch of an alignment that holds, or None."""
    found = stretch(a, b, offset)
    if found[0] < ENOUGH:
        found = stretch(a, b, offset, steady=True)
        if found[1] < STEADY * min(len(a), len(b)):
            return None
    return found if found[0] >= ENOUGH and found[1] >= least_votes else None


def _posts(reps: DataFrame) -> DataFrame:
    """``reps(row, prints)`` → (row, pos, value), values as ``numbered``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, made = pa.compute.list_value_length(batch.column(1)).to_numpy(), [numbered(p.values.to_numpy()) for p in batch.column(1)]
            pos = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if len(sizes) else np.zeros(0, np.int32)
            row = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([row, pa.array(pos), pa.array(np.concatenate(made) if made else np.zeros(0, np.int64))], ["row", "pos", "value"])

    return reps.select("row", "prints").mapInArrow(run, with_fields(reps, ["row"], pos="int", value="long"))


def _onward(prints: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the places in order of (value, place) that ``least`` others follow: values, places, how many follow each, and their hashes.

    The hash of a place that follows is of its value and of how far it is away, so it is the same in all recordings.
    """
    values = numbered(prints)
    order = np.argsort(values, kind="stable")
    v, at, n = values[order].view(np.uint64), order.astype(np.int64), max(0, len(order) - least)
    sizes = len(order) - 1 - np.arange(n)
    i = np.repeat(np.arange(n), sizes)
    j = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + i + 1
    h = (v[j] ^ ((at[j] - at[i]).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return values[order][:n], at[:n].astype(np.int32), sizes, h >> np.uint64(64 - 8 * WIDE)


def _followed(reps: DataFrame, least: int) -> DataFrame:
    """``reps(row, prints)`` → (value, row, pos, left, again, after): prints from the place on, those in the recording that repeat the one before, and the hashes of ``_onward``, ``WIDE`` bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            prints = [p.values.to_numpy() for p in batch.column(1)]
            made = [_onward(p, least) for p in prints]
            value, pos, sizes, after = (np.concatenate(c) for c in zip(*made))
            places = [len(m[0]) for m in made]
            left = np.repeat([len(p) for p in prints], places) - pos
            again = np.repeat([(p[1:] == p[:-1]).sum() for p in prints], places)
            data = np.ascontiguousarray(after.view(np.uint8).reshape(-1, 8)[:, :WIDE])
            ends = np.concatenate(([0], np.cumsum(sizes) * WIDE)).astype(np.int32)
            row = batch.column(0).take(pa.array(np.repeat(np.arange(len(made)), places)))
            binary = pa.Array.from_buffers(pa.binary(), len(pos), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(value), row, pa.array(pos), pa.array(left, pa.int32()), pa.array(again, pa.int32()), binary], ["value", "row", "pos", "left", "again", "after"])

    return reps.select("row", "prints").mapInArrow(run, "value long, row long, pos int, left int, again int, after binary")


def _needed(place: list[np.ndarray], i: np.ndarray, j: np.ndarray, need: int) -> np.ndarray:
    """How many that follow must agree at the places ``i`` and ``j`` of ``place`` (pos, left, again), ``need`` or more; as many as can't be where no stretch there can hold.

    A stretch of the ``n`` prints that lie side by side scores 4 for an equal print and 3 for another at most, so it takes
    ``ENOUGH`` - 3 n equal ones.  Equal prints are equal values but where one of them repeats the print before it.
    """
    pos, left, again = place
    n = np.minimum(pos[i], pos[j]).astype(np.int64) + np.minimum(left[i], left[j])
    least = np.maximum(need, ENOUGH - (EVEN - 1) * n - again[i] - again[j] - 1)
    return np.where(EVEN * n >= ENOUGH, least, n + 1)


def _agreeing(group: np.ndarray, sizes: np.ndarray, after: np.ndarray, need: int, place: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i > j, of places of one ascending ``group`` with exactly ``need`` equal hashes in ``after``, which holds ``sizes`` for each.

    With ``place`` exactly as many as ``_needed`` asks for.
    """
    def exact(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        return i[n == need] * len(sizes) + j[n == need] if place is None else (i * len(sizes) + j)[n == _needed(place, i, j, need)]

    holder = np.repeat(np.arange(len(sizes)), sizes)
    key = (group[holder].astype(np.uint64) << np.uint64(8 * WIDE)) | after
    order = np.argsort(key, kind="stable")
    key, holder = key[order], holder[order]
    equal = np.concatenate(([False], key[1:] == key[:-1], [False]))
    shared = equal[1:] | equal[:-1]
    key, holder, starts = key[shared], holder[shared], ~equal[:-1][shared]
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(starts)
    start = first[np.cumsum(starts) - 1]
    pairs = np.arange(len(key)) - start  # with all before it in its run
    of = group[holder]
    per = np.zeros(int(group[-1]) + 1, np.int64)
    np.add.at(per, of, pairs)
    out, turn = [], (np.cumsum(per) - per) // PAIRS  # groups that are taken together
    for t in np.unique(turn[of]):
        mine = np.flatnonzero(turn[of] == t)
        if pairs[mine].sum() <= 4 * PAIRS:
            left = np.repeat(mine, pairs[mine])
            right = np.arange(len(left)) - np.repeat(np.cumsum(pairs[mine]) - pairs[mine], pairs[mine]) + start[left]
            both, n = np.unique(holder[left] * len(sizes) + holder[right], return_counts=True)
            both, n = both[n >= need], n[n >= need]
            out.append(exact(both // len(sizes), both % len(sizes), n))
        else:  # few holders with very many hashes in common: counted in a table of the holders
            for g in np.unique(of[mine]):
                own = mine[of[mine] == g]
                names, which = np.unique(holder[own], return_inverse=True)
                n = np.zeros((len(names), len(names)), np.int32)
                for k in np.split(which, np.flatnonzero(starts[own])[1:]):
                    n[np.ix_(k, k)] += 1
                i, j = np.nonzero(np.tril(n, -1) >= max(need, 1))
                out.append(exact(names[i], names[j], n[i, j]))
    both = np.concatenate(out)
    return both // len(sizes), both % len(sizes)


def _met(held: DataFrame, need: int) -> DataFrame:
    """``held(value, low, high, own, row, pos, left, again, after)``, sorted by the first three → (x, y, offset), x > y, of places that agree in ``need`` that follow, or in more where a stretch takes them."""
    def found(part: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        ends = np.frombuffer(part.column(8).buffers()[1], np.int32)[part.column(8).offset :][: part.num_rows + 1].astype(np.int64)
        data = np.frombuffer(part.column(8).buffers()[2], np.uint8)[ends[0] : ends[-1]]
        after = np.zeros((len(data) // WIDE, 8), np.uint8)
        after[:, :WIDE] = data.reshape(-1, WIDE)
        low, high, own, row, *place = (part.column(k).to_numpy() for k in range(1, 8))
        i, j = _agreeing(group, np.diff(ends) // WIDE, after.view(np.uint64)[:, 0], need, place)
        pos = place[0]
        right = (row[i] != row[j]) & ((low[i] == high[i]) | (own[i] != own[j]))
        i, j = i[right], j[right]
        i, j = np.where(row[i] > row[j], i, j), np.where(row[i] > row[j], j, i)
        return pa.RecordBatch.from_arrays([pa.array(row[i]), pa.array(row[j]), pa.array(pos[i] - pos[j])], ["x", "y", "offset"])

    def groups(part: pa.RecordBatch) -> np.ndarray:
        keys = [part.column(k).to_numpy() for k in range(3)]
        return np.cumsum(np.any([np.diff(k, prepend=k[:1]) != 0 for k in keys], axis=0)) if part.num_rows else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            kept, size = [*kept, batch], size + batch.get_total_buffer_size()
            if size >= TAKEN:
                part = pa.concat_batches(kept)
                group = groups(part)
                whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if whole:
                    yield found(part.slice(0, whole), group[:whole])
                kept, size = [part.slice(whole)], 0
        if kept:
            part = pa.concat_batches(kept)
            if part.num_rows:
                yield found(part, groups(part))

    return held.select("value", "low", "high", "own", "row", "pos", "left", "again", "after").mapInArrow(run, "x long, y long, offset int")


def _candidates(reps: DataFrame, least_votes: int, scratch: Scratch, long: int, tile: int) -> DataFrame:
    """``reps(row, prints)`` → (x, y, offset), x > y, distinct: all pairs that have ``least_votes`` prints in common at an offset, but those of which ``_needed`` tells that none can hold.

    Places of one value meet with the hashes of the places after them in order of (value, place).  Those of an alignment come in
    one order in both recordings, so it is seen once, at its ``least_votes``-th from the end (``_needed`` may ask for more), however many places agree; of
    places that share a value alone no pairs are made.  A value of more than ``tile`` places is dealt in tiles of two blocks
    of recordings.  Recordings of more than ``long`` prints meet all others by the values themselves, as what follows all
    their places grows with the square of their length.
    """
    posts, n = _posts(reps), F.size("prints")
    far = scratch.stage(reps.where(n > long).select("row", "prints"), "long")
    found = None
    if least_votes > 1:
        short = reps.where(n <= long)
        blocks = scratch.stage(posts.groupBy("value").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks")).where("blocks > 1"), "blocks")
        dealt = _followed(short, least_votes - 1).join(F.broadcast(blocks), "value", "left")  # a row for each ``tile`` places at most
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("row"), F.coalesce("blocks", F.lit(1))).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
        dealt = dealt.select("value", "row", "pos", "left", "again", "own", "after", other.alias("other")).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        held = dealt.repartition("value", "low", "high").sortWithinPartitions("value", "low", "high")
        found = _met(held, least_votes - 1)
    if least_votes == 1 or not far.isEmpty():
        mine = posts if least_votes == 1 else _posts(far)
        pairs = mine.select(F.col("row").alias("a"), F.col("pos").alias("p"), "value").join(posts.select(F.col("row").alias("b"), F.col("pos").alias("q"), "value").hint("merge"), "value").where("a != b")
        offset = F.when(F.col("a") > F.col("b"), F.col("p") - F.col("q")).otherwise(F.col("q") - F.col("p"))
        # two long ones meet twice, with the same votes
        votes = pairs.groupBy("a", "b", F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"), offset.alias("offset")).agg(F.count("*").alias("votes"))
        more = votes.where(F.col("votes") >= least_votes).select("x", "y", "offset").distinct()
        found = more if found is None else found.unionByName(more)
    return found


def _verified(pairs: DataFrame, least_votes: int) -> DataFrame:
    """``pairs(rep, hub, offsets, a, b)`` → (rep, hub, offset, overlap, bit_errors) of the best stretch of all offsets, if it is long enough."""
    names = ["rep", "hub", "offset", "overlap", "bit_errors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            offsets, a, b = batch.column(2).to_pylist(), batch.column(3), batch.column(4)
            rows = []
            for k, tried in enumerate(offsets):
                x, y = (c[k].values.to_numpy(zero_copy_only=False).astype(np.int32) for c in (a, b))
                u, v = numbered(x), numbered(y)
                found = [(made[0], o, *made[1:]) for o in tried if votes(u, v, o) >= least_votes and (made := aligned(x, y, o, least_votes))]
                _, offset, n, wrong = max(found, key=lambda r: (r[0], -abs(r[1]), r[1]), default=(0, 0, 0, 0))
                rows.append((offset, n, wrong, bool(found)))
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols], names).filter(pa.array([r[3] for r in rows], pa.bool_()))

    return pairs.mapInArrow(run, with_fields(pairs, ["rep", "hub"], offset="long", overlap="long", bit_errors="long"))


def align(media: DataFrame, key: str, column: Column, least_votes: int = 3, long: int = LONG, tile: int = TILE) -> DataFrame:
    """key, n_prints, class_id, group_id, n_links, match_id, offset, overlap and bit_errors of every recording.

    ``class_id`` is the least key with the same fingerprints, ``group_id`` the least class that alignments reach.
    Two classes align if ``least_votes`` of their prints have the same values at one offset and the best stretch
    there, of any offset with so many, holds (``aligned``).
    All pairs of classes are looked at, however many share a print.  ``long`` and ``tile`` (``_candidates``) don't change the result.
    ``n_links`` counts the classes that align with the class, ``match_id`` is the one with most bits right (then the
    least id), null without one; ``offset`` is where it starts in this recording, ``overlap`` the stretch in prints.
    Media of fewer than ``least_votes`` prints (under 1,280 bytes) align with none.  Null and empty recordings
    have no prints, are one class and link to none; repeated rows stay; null keys never stand for a class that
    has another; no rows give no rows.
    """
    with Scratch(media.sparkSession) as scratch:
        rows = scratch.keep(with_prints(media.select(quoted(key).alias("key"), column.alias("media")), ["key"], F.col("media"))
                            .withColumn("digest", F.sha2(F.array_join("prints", ","), 256)), "prints")
        # 60 bits of the digest tell apart rows of one key; the whole digest in every posting would be most of what is shuffled
        order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("tag"))
        reps = rows.groupBy("digest").agg(F.min(order).alias("rep"), F.first("prints").alias("prints")).select(F.monotonically_increasing_id().alias("row"), "digest", "rep", "prints")
        reps = scratch.stage(reps, "classes")
        # no stretch of fewer prints can reach the score
        found = _candidates(reps.where(F.size("prints") >= max(least_votes, -(-ENOUGH // EVEN))).select("row", "prints"), least_votes, scratch, long, tile)
        tried = scratch.stage(found.groupBy("x", "y").agg(F.collect_set("offset").alias("offsets")), "tried")
        ends = [reps.select(F.col("row").alias(r), F.col("rep").alias(n), F.col("prints").alias(c)).hint("merge") for r, n, c in (("x", "rep", "a"), ("y", "hub", "b"))]
        pairs, swap = tried.join(ends[0], "x").join(ends[1], "y"), F.col("rep") < F.col("hub")
        turned = lambda one, two: F.when(swap, F.col(two)).otherwise(F.col(one)).alias(one)
        pairs = pairs.select(turned("rep", "hub"), turned("hub", "rep"), F.when(swap, F.transform("offsets", lambda o: -o)).otherwise(F.col("offsets")).alias("offsets"), turned("a", "b"), turned("b", "a"))
        links = scratch.stage(_verified(pairs, least_votes), "links")
        other = links.select(F.col("hub").alias("rep"), F.col("rep").alias("hub"), (-F.col("offset")).alias("offset"), "overlap", "bit_errors")
        match = F.struct((F.col("bit_errors") - 32 * F.col("overlap")).alias("right"), F.col("hub").alias("hub"), "offset", "overlap", "bit_errors")
        chosen = scratch.stage(links.unionByName(other).groupBy("rep").agg(F.count("*").alias("n_links"), F.min(match).alias("m")), "chosen")
        groups = connected_components(links.select(F.col("rep").alias("a"), F.col("hub").alias("b")), scratch=scratch).withColumnRenamed("node", "rep")
        full = scratch.keep(reps.select("digest", "rep").join(chosen.hint("merge"), "rep", "left").join(groups.hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "full")
    return rows.select("key", "digest", F.size("prints").cast("long").alias("n_prints")).join(full.hint("merge"), "digest").select(
        F.col("key").alias(key), "n_prints", F.col("rep.key").alias("class_id"), F.col("root.key").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("m.hub.key").alias("match_id"), F.col("m.offset").alias("offset"), F.col("m.overlap").alias("overlap"), F.col("m.bit_errors").alias("bit_errors"))
