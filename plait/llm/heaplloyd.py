"""Vector code compression: codebooks of vector parts by Lloyd rounds over partition-local heaps.

Vectors are cut into equal parts; each part position has a codebook, and a vector's code is the index of each
part's nearest entry.  Rows are kept in chunks, a table row each.  A chunk holds, for each part position and
entry, a heap of the parts assigned there, keyed by the slack between the bounds at their last scan (the
distance of the second nearest entry less that of the nearest) plus the drift that the entry's bounds had gathered by
then.  When entries move, an entry's upper bounds grow by its own step and its lower bounds shrink by the longest step
of any other, so the sum of both is the drift of a whole heap.  A round pops the parts whose key the drift has
reached, and only these are scanned again, exactly; all others keep their nearest entry.

Sums and counts of the entries follow from the parts that moved.  A round's chunks are written as a table in
the shared folder, so a lost executor costs its own chunks of one round; what reaches the driver is one sum
for each component of an entry.  Components are whole numbers and distances are exact: in doubles where all sums stay
below 2^52, else in Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from plait.llm.vectors import usable
from plait.plans.staging import Scratch

#: Vectors of a chunk, and rows that are compared with a codebook at a time.
CHUNK, SCAN = 8192, 2048
#: Labels up to this many are broadcast with their sums, more are joined by sorting.
FEW_LABELS = 100_000
EXACT = 1 << 52
LIMB = 32
LONGEST = (1 << 63) - 1


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale · x), as the narrowest integers that hold it, else as objects."""
    scaled = np.floor(x * scale)
    top = np.abs(scaled).max(initial=0)
    for kind in (np.int16, np.int32, np.int64):
        if top < np.iinfo(kind).max // 2:
            return scaled.astype(kind)
    return np.array([[int(c) if np.isfinite(c) else int(a) * scale for c, a in zip(cs, row)] for cs, row in zip(scaled, x)], object)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    if x.dtype == object:
        return "text", " ".join(map(str, x.ravel())).encode()
    return x.dtype.str, np.ascontiguousarray(x).tobytes()


def _unpacked(kind: str, held: bytes, width: int) -> np.ndarray:
    x = np.array([int(c) for c in held.split()], object) if kind == "text" else np.frombuffer(held, kind)
    return x.reshape(-1, width)


class Books:
    """The codebooks of one round with the drift gathered so far; what a pass over the chunks needs."""

    def __init__(self, entries: np.ndarray, drift: np.ndarray):
        self.entries, self.drift = entries, drift  # parts × entries × width, as objects; parts × entries
        self.top = max((abs(c) for c in entries.ravel()), default=0)

    def kind(self, x: np.ndarray) -> type:
        """float where all distances from ``x`` are exact in doubles, else object."""
        top = max(self.top, int(max((abs(int(c)) for c in (x.max(initial=0), x.min(initial=0))), default=0)))
        return float if self.entries.shape[2] * (2 * top) ** 2 < EXACT else object

    def moved_to(self, entries: np.ndarray) -> Books:
        """The next round's: every heap's drift grows by its entry's step and the longest step of the others."""
        steps = np.sqrt((((entries - self.entries) ** 2).sum(axis=2)).astype(float))
        drift = self.drift + steps
        if steps.shape[1] > 1:
            ends = np.sort(steps, axis=1)[:, -2:]
            longest = steps.argmax(axis=1)
            others = np.repeat(ends[:, 1:], steps.shape[1], axis=1)
            others[np.arange(len(steps)), longest] = ends[:, 0]
            drift = drift + others
        return Books(entries, drift)


def _scan(x: np.ndarray, book: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x``: the first nearest entry, and how much farther the next one is."""
    where, slack = np.empty(len(x), np.int64), np.empty(len(x))
    book = book.astype(kind)
    norms = (book * book).sum(axis=1)
    for at in range(0, len(x), SCAN if kind is float else 64):
        part = x[at : at + (SCAN if kind is float else 64)].astype(kind)
        far = (part * part).sum(axis=1)[:, None] - 2 * (part @ book.T) + norms
        rows, first = np.arange(len(part)), far.argmin(axis=1)
        least = far[rows, first].astype(float)
        where[at : at + len(part)] = first
        if book.shape[0] == 1:
            slack[at : at + len(part)] = np.inf
            continue
        far = far.astype(float)
        far[rows, first] = np.inf
        slack[at : at + len(part)] = np.sqrt(far.min(axis=1)) - np.sqrt(least)
    return where, slack


class Heaps:
    """One part position of a chunk: for each entry a heap of (key, row), as slices of two arrays until it is touched."""

    def __init__(self, ends: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        self.ends, self.keys, self.rows, self.touched = ends, keys, rows, {}

    @classmethod
    def built(cls, where: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((keys, where))  # a sorted list is a heap
        return cls(np.cumsum(np.bincount(where, minlength=entries)).astype(np.int32), keys[order], order.astype(np.int32))

    def heap(self, e: int) -> list[tuple[float, int]]:
        if e not in self.touched:
            a, b = self.ends[e - 1] if e else 0, self.ends[e]
            self.touched[e] = list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist()))
        return self.touched[e]

    def violated(self, limits: np.ndarray) -> tuple[list[int], list[int]]:
        """Rows popped because their key is within the limit of their entry, and these entries."""
        starts = np.concatenate([[0], self.ends[:-1]])
        held = np.flatnonzero(self.ends > starts)
        rows, entries = [], []
        for e in held[self.keys[starts[held]] <= limits[held]].tolist():
            heap, limit = self.heap(e), limits[e]
            while heap and heap[0][0] <= limit:
                rows.append(heappop(heap)[1])
                entries.append(e)
        return rows, entries

    def push(self, e: int, key: float, row: int) -> None:
        heappush(self.heap(e), (key, row))

    def settled(self) -> Heaps:
        """The same with all heaps as slices again."""
        if not self.touched:
            return self
        starts = np.concatenate([[0], self.ends[:-1]])
        keys, rows, sizes = [], [], []
        for e, (a, b) in enumerate(zip(starts.tolist(), self.ends.tolist())):
            if e in self.touched:
                heap = self.touched[e]
                keys.append(np.array([k for k, _ in heap], float))
                rows.append(np.array([r for _, r in heap], np.int32))
            else:
                keys.append(self.keys[a:b])
                rows.append(self.rows[a:b])
            sizes.append(len(keys[-1]))
        return Heaps(np.cumsum(sizes).astype(np.int32), np.concatenate(keys), np.concatenate(rows))

    def where(self) -> np.ndarray:
        """The entry of each row."""
        out = np.empty(len(self.rows), np.int64)
        out[self.rows] = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
        return out


def _changes(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> dict[int, np.ndarray]:
    """entry → count and component sums of the rows that came, less those that left."""
    out: dict[int, np.ndarray] = {}
    wide = x.astype(object if x.dtype in (object, np.int64) else np.int64)
    for sign, where in ((1, new), (-1, old)):
        if where is None or not len(where):
            continue
        order = np.argsort(where, kind="stable")
        found, starts = np.unique(where[order], return_index=True)
        sums, sizes = np.add.reduceat(wide[order], starts, axis=0), np.diff([*starts, len(where)])
        for e, s, n in zip(found.tolist(), sums, sizes.tolist()):
            row = sign * np.concatenate([np.array([n], object), s.astype(object)])
            out[e] = out[e] + row if e in out else row
    return out


def _first(x: np.ndarray, books: Books, kind: type) -> tuple[list[Heaps], list[dict]]:
    """Heaps of a new chunk, every part scanned, and what its parts add to each codebook."""
    heaps, sums, n = [], [], books.entries.shape[1]
    for p, (book, part) in enumerate(zip(books.entries, np.split(x, len(books.entries), axis=1))):
        where, slack = _scan(part, book, kind)
        heaps.append(Heaps.built(where, slack + books.drift[p][where], n))
        sums.append(_changes(part, None, where, n))
    return heaps, sums


def _later(x: np.ndarray, heaps: list[Heaps], books: Books, kind: type) -> tuple[list[Heaps], list[dict]]:
    """The heaps after the codebooks moved: parts whose bounds no longer hold are scanned again."""
    out, sums = [], []
    for p, (heap, book, part) in enumerate(zip(heaps, books.entries, np.split(x, len(books.entries), axis=1))):
        drift = books.drift[p]
        finite = heap.keys[np.isfinite(heap.keys)]
        # equal distances are scanned again, as are those that rounding could make look unequal
        limits = drift + 1e-9 * (1 + drift + np.abs(finite).max(initial=0) + abs(float(books.top)))
        rows, old = heap.violated(limits)
        where, slack = _scan(part[rows], book, kind)
        for e, key, row in zip(where.tolist(), (slack + drift[where]).tolist(), rows):
            heap.push(e, key, row)
        left = np.flatnonzero(where != np.array(old, np.int64))
        sums.append(_changes(part[np.array(rows, np.int64)[left]], np.array(old, np.int64)[left], where[left], len(book)))
        out.append(heap.settled())
    return out, sums


def _sum_rows(sums: list[dict]) -> list[dict]:
    """Rows (slot, pos, limb, value): the sums cut into limbs of 32 bits, the last of which has the sign."""
    out = []
    for p, found in enumerate(sums):
        for e, row in found.items():
            for pos, value in enumerate(row.tolist()):
                limb = 0
                while not -(1 << 62) <= value < 1 << 62:
                    out.append({"slot": p << 16 | e, "pos": pos, "limb": limb, "value": value & ((1 << LIMB) - 1)})
                    value, limb = value >> LIMB, limb + 1
                if value:
                    out.append({"slot": p << 16 | e, "pos": pos, "limb": limb, "value": value})
    return out


_SUMS = pa.list_(pa.struct([("slot", pa.int32()), ("pos", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))
_STATE = "kind string, vecs binary, ends binary, keys binary, members binary, sums array<struct<slot:int,pos:int,limb:int,value:bigint>>"


def _row(ids, labels, packed: tuple[str, bytes], heaps: list[Heaps], sums: list[dict]) -> pa.RecordBatch:
    joined = lambda name: b"".join(np.ascontiguousarray(getattr(h, name)).tobytes() for h in heaps)
    held = [pa.array([packed[0]]), pa.array([packed[1]], pa.binary())] + [pa.array([joined(n)], pa.binary()) for n in ("ends", "keys", "rows")]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels)]
    return pa.RecordBatch.from_arrays([*lists, *held, pa.array([_sum_rows(sums)], _SUMS)], ["ids", "labels", "kind", "vecs", "ends", "keys", "members", "sums"])


def _joined(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _chunks(rows: DataFrame, width: int, books: Books, scale: int) -> DataFrame:
    """``rows(id, label, v)`` → chunks with heaps."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made(table: pa.Table) -> pa.RecordBatch:
            flat = np.asarray(_joined(table.column("v")).flatten(), float).reshape(-1, width)
            x = _integers(flat, scale)
            heaps, sums = _first(x, shared.value, shared.value.kind(x))
            return _row(_joined(table.column("id")), _joined(table.column("label")), _packed(x), heaps, sums)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= CHUNK:
                table = pa.Table.from_batches(held)
                yield made(table.slice(0, CHUNK))
                held, n = table.slice(CHUNK).to_batches(), n - CHUNK
        if n:
            yield made(pa.Table.from_batches(held))

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, {_STATE}")


def _read(row: dict, width: int, books: Books) -> tuple[np.ndarray, list[Heaps]]:
    x = _unpacked(row["kind"], row["vecs"], width)
    parts, entries = books.entries.shape[:2]
    ends = np.frombuffer(row["ends"], np.int32).reshape(parts, entries)
    keys, members = np.frombuffer(row["keys"]).reshape(parts, len(x)), np.frombuffer(row["members"], np.int32).reshape(parts, len(x))
    return x, [Heaps(*h) for h in zip(ends, keys, members)]


def _advanced(chunks: DataFrame, width: int, books: Books) -> DataFrame:
    """Chunks whose heaps follow the codebooks."""
    shared = chunks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("kind", "vecs", "ends", "keys", "members")}
                x, heaps = _read(row, width, shared.value)
                heaps, sums = _later(x, heaps, shared.value, shared.value.kind(x))
                yield _row(batch.column("ids")[k].values, batch.column("labels")[k].values, (row["kind"], row["vecs"]), heaps, sums)

    return chunks.drop("sums").mapInArrow(run, chunks.schema)


def _coded(chunks: DataFrame, width: int, books: Books) -> DataFrame:
    """(vec_id, label, code, error) of all vectors, by codebooks that the chunks have not met yet."""
    shared = chunks.sparkSession.sparkContext.broadcast(books)
    kinds = {c: chunks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, heaps = _read({c: batch.column(c)[k].as_py() for c in ("kind", "vecs", "ends", "keys", "members")}, width, shared.value)
                kind = shared.value.kind(x)
                heaps, _ = _later(x, heaps, shared.value, kind)
                where = np.stack([h.where() for h in heaps], axis=1)
                error = 0
                for book, part, w in zip(shared.value.entries, np.split(x, len(heaps), axis=1), where.T):
                    off = part.astype(kind) - book.astype(kind)[w]
                    error = error + (off * off).sum(axis=1)
                codes = [row.tobytes().hex() for row in where.astype(np.uint8)]
                errors = pa.array([min(int(e), LONGEST) for e in error], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array(codes), errors], ["vec_id", "label", "code", "error"])

    return chunks.drop("sums").mapInArrow(run, f"vec_id {kinds['ids']}, label {kinds['labels']}, code string, error bigint")


def _gathered(chunks: DataFrame, totals: np.ndarray) -> np.ndarray:
    """``totals`` (parts × entries × (count, components)) with the chunks' changes added."""
    totals = totals.copy()
    found = chunks.select(F.inline("sums")).groupBy("slot", "pos", "limb").agg(F.sum("value").alias("value"))
    for r in found.collect():  # one row for each component of an entry, whatever the number of vectors
        totals[r.slot >> 16, r.slot & 0xFFFF, r.pos] += r.value << LIMB * r.limb
    return totals


def _means(totals: np.ndarray, old: np.ndarray) -> np.ndarray:
    n = totals[:, :, :1]
    return np.where(n > 0, totals[:, :, 1:] // np.maximum(n, 1), old)


def codebooks_digest(entries: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, entries.ravel())).encode()).hexdigest()


def compress(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every vector that can be coded.

    Components become floor(scale · x).  Codebooks start as the parts of the ``entries`` vectors of least id (null ids
    last, equal ids by their components) and move ``rounds`` times to the floors of their parts' means; entries without
    parts stay.  Ties go to the lower index.  ``error`` is the squared distance of a vector to its code's entries,
    ``label_error`` the sum over vectors of its label (null labels are one); both stop at the largest long.
    Vectors that are null, hold null or non-finite components, or are not of the commonest length that
    ``parts`` divides, have no row.  Repeated rows are coded each; no vectors give no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part, so 256 entries at most")
    rows, width = usable(table, vec_id, embedding, parts, label=label)
    firsts = rows.orderBy(F.col("id").isNull(), "id", "v").limit(entries).collect() if width else []
    if not firsts:
        kinds = StructType([rows.schema["id"], rows.schema["label"]])
        kinds.fields[0].name = "vec_id"
        for name in ("code", "error", "label_error", "codebooks_sha256"):
            kinds = kinds.add(name, LongType() if "error" in name else "string")
        return table.sparkSession.createDataFrame([], kinds)
    seeds = _integers(np.array([r.v for r in firsts]), scale).astype(object)
    books = Books(np.stack(np.split(seeds, parts, axis=1)), np.zeros((parts, len(seeds))))
    totals = np.zeros((parts, len(seeds), width // parts + 1), object)
    with Scratch(table.sparkSession) as scratch:
        chunks = scratch.stage(_chunks(rows, width, books, scale), "chunks")
        for k in range(rounds):
            totals = _gathered(chunks, totals)
            books = books.moved_to(_means(totals, books.entries))
            if k < rounds - 1:
                chunks = scratch.stage(_advanced(chunks, width, books), "chunks")
                scratch.forget(last=False)
        coded = scratch.keep(_coded(chunks, width, books), "coded")
    sums = scratch.keep(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error")), "labels")
    sums = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums.hint("merge")
    out = coded.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")), "left")
    return out.select("c.vec_id", "c.label", "c.code", "c.error", "s.label_error", F.lit(codebooks_digest(books.entries)).alias("codebooks_sha256"))
