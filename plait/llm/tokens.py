"""Token-ID output as directly addressable codes.

An id is cut into chunks of 8 bits, lowest first.  Level k of a file holds the k-th chunk of every id
that has one, a bitmap that tells which of them go on to level k + 1, and a rank directory (ones before
each 512-bit block), so that token i is found by one rank per level and no block is decoded.

File layout, little-endian: magic, counts (documents, tokens, levels), then the documents' ids, flags of
null ids and first tokens, then for each level its length, chunks, bitmap words and directory, all padded
to 8 bytes.

Documents are dealt by ranges of their id and sorted within a range, so that files in order of (part, seq)
hold them in ascending order.  A file is closed at ``FILE_TOKENS`` tokens and has a name no other attempt
of the task uses; only the manifest that Spark commits says which files count, so lost executors leave at
most files that nothing names.
"""

from __future__ import annotations

import gc
import hashlib
import json
import sys
import types
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.schemas import quoted
from plait.plans.staging import new_path, stage

END_ID = 2
FILE_TOKENS = 1 << 21
#: Tokens that are read at a time, and bytes of a file that are.
READ_TOKENS, BLOCK_BYTES = 1 << 17, 1 << 16
MAGIC = b"PLAITDA1"
BLOCK = 512
MEMO_WORDS = 500_000
#: Words whose characters the tokenizer's text rules treat as Python does: printable ASCII and Latin letters.
PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
#: Fixed value: the pattern of the vocabulary's pre-tokenizer.
RULES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = regex.compile(RULES)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer of that name is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by a tokenizers file; where that works on pieces of words, unseen words only are encoded.

    The tokenizer's text rules never look beyond ASCII white space, so words are encoded once each.  A word of
    plain Latin characters is lower-cased and cut into the tokenizer's pieces here, and only unseen pieces go
    to the library, many at a time: the last id of each piece is one that ends a word.  All other words go to
    the library as they are.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(vocabulary)
        model = spec["model"]
        kinds = [r.get("type") for r in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        #: Whether the vocabulary's text rules are those that words are cut by here; else whole texts go to the library.
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and cut == RULES and bool(model.get("end_of_word_suffix"))
        suffix = model.get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        # the same model for pieces that are cut and normalised already; printable ASCII stands for its own bytes
        self.bare, self.bare_ascii = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.bare_ascii.pre_tokenizer = WhitespaceSplit()
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo: dict[bytes, bytes] = {}

    def _raw(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, pieces: list[bytes], tokenizer) -> None:
        for at in range(0, len(pieces), 1024):
            part = pieces[at : at + 1024]
            ids = self._raw([b" ".join(part).decode()], tokenizer)[0]
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) == len(part):
                raw, begin = ids.tobytes(), 0
                for piece, end in zip(part, cuts.tolist()):
                    self.memo[piece] = raw[begin:end]
                    begin = end
            else:
                self.memo.update(zip(part, (x.tobytes() for x in self._raw([p.decode() for p in part], tokenizer))))

    def _learn(self, words: list[bytes]) -> None:
        """Encode unseen words, A-Z in lower case; a piece is remembered as the word that it would be alone."""
        memo, need, tailed, cut, other = self.memo, set(), [], [], []
        for word in words:
            if word.isalpha():
                need.add(word)
                continue
            core = word.rstrip(b".,;:!?")
            if core.isalpha():
                tail = word[len(core) :]
                need.add(core)
                need.add(tail)
                tailed.append((word, core, tail))
                continue
            text = word.decode("utf-8", "replace")
            if PLAIN.fullmatch(text):
                found = [p.encode() for p in PIECES.findall(text.lower())]
                need.update(found)
                cut.append((word, found))
            else:
                other.append((word, text))
        need = need.difference(memo)
        plain = [p for p in need if p.isascii()]
        self._learn_pieces(plain, self.bare_ascii)
        self._learn_pieces(list(need.difference(plain)), self.bare)
        for word, core, tail in tailed:
            memo[word] = memo[core] + memo[tail]
        for word, found in cut:
            memo[word] = b"".join([memo[p] for p in found])
        if other:
            memo.update(zip((w for w, _ in other), (x.tobytes() for x in self._raw([t for _, t in other]))))

    def forget(self) -> None:
        """Let the remembered words go."""
        self.memo.clear()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.known:
            return [x.tobytes() for x in self._raw([(t or b"").decode("utf-8", "replace") for t in texts])]
        memo, split = self.memo, [t.lower().split() if t else [] for t in texts]
        if unseen := set(filterfalse(memo.__contains__, chain.from_iterable(split))):
            if len(memo) + len(unseen) > MEMO_WORDS:
                memo.clear()
                unseen = set(chain.from_iterable(split))
            self._learn(list(unseen))
        return [b"".join(map(memo.__getitem__, words)) for words in split]


def _groups(bodies: Iterator[bytes | None], most: int = 1 << 19) -> Iterator[list[bytes | None]]:
    """The texts in lists of about ``most`` bytes."""
    held, n = [], 0
    for body in bodies:
        held.append(body)
        n += len(body or b"")
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def encoder(vocabulary: str) -> Encoder:
    """The encoder of this Python worker, kept between tasks."""
    keep = sys.modules.setdefault("_plait_worker", types.ModuleType("_plait_worker"))
    key = hashlib.sha256(vocabulary.encode()).digest()
    if getattr(keep, "encoder", (None, None))[0] != key:
        keep.encoder = (key, Encoder(vocabulary))
    return keep.encoder[1]


def _padded(a: np.ndarray) -> bytes:
    raw = a.tobytes()
    return raw + b"\0" * (-len(raw) % 8)


def pack(doc_ids: list[int | None], starts: list[int], ids: np.ndarray) -> bytes:
    """The file of these documents; ``starts`` has one more entry than documents."""
    levels, left = [], ids.astype("<u4")
    while len(left) or not levels:
        more = left > 255
        bits = np.zeros(-(-len(left) // 64) * 64, bool)
        bits[: len(left)] = more
        words = np.packbits(bits, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(words), np.arange(0, len(words), BLOCK // 8), dtype=np.int64) if len(words) else np.zeros(0, np.int64)
        directory = np.concatenate(([0], np.cumsum(ones)))[: max(1, len(ones))].astype("<u8")
        levels.append(np.array([len(left)], "<u8").tobytes() + _padded((left & 255).astype(np.uint8)) + _padded(words) + _padded(directory))
        left = left[more] >> 8
    head = MAGIC + np.array([len(doc_ids), len(ids), len(levels)], "<u8").tobytes()
    names = _padded(np.array([0 if d is None else d for d in doc_ids], "<i8")) + _padded(np.array([d is None for d in doc_ids], np.uint8))
    return b"".join([head, names, _padded(np.array(starts, "<u8")), *levels])


class Ranges:
    """Bytes of an open file by place, read in blocks of ``BLOCK_BYTES``, the last few of which are held."""

    def __init__(self, file, held: int = 16):
        self.file, self.size, self.held, self.blocks = file, file.size(), held, OrderedDict()

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            self.blocks[k] = self.file.read_at(min(BLOCK_BYTES, self.size - k * BLOCK_BYTES), k * BLOCK_BYTES)
            if len(self.blocks) > self.held:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(k)
        return self.blocks[k]

    def read(self, at: int, n: int) -> bytes:
        first, last = at // BLOCK_BYTES, (at + max(n, 1) - 1) // BLOCK_BYTES
        if first == last:
            return self._block(first)[at - first * BLOCK_BYTES : at - first * BLOCK_BYTES + n]
        if last - first >= self.held:
            return self.file.read_at(n, at)
        return b"".join(self._block(k) for k in range(first, last + 1))[at - first * BLOCK_BYTES : at - first * BLOCK_BYTES + n]


class TokenFile:
    """Random access to the tokens of a packed file, given as bytes or as an open file that can be read at any place.

    A token costs its chunk, a word of the bitmap and a rank at each level it goes through, whatever the file's
    size; the documents' ids and first tokens are read when asked for.
    """

    def __init__(self, source):
        self.ranges = Ranges(pa.BufferReader(source) if isinstance(source, bytes) else source)
        if self.ranges.read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        self.docs, self.n_tokens, n_levels = (int(x) for x in self._array("<u8", 8, 3))
        self.after_ids = 32 + 8 * self.docs
        self.after_nulls = self.after_ids + -(-self.docs // 8) * 8
        at, self.levels = self.after_nulls + 8 * (self.docs + 1), []
        for _ in range(n_levels):  # where a level's chunks, bitmap and directory are
            n = int(self._array("<u8", at, 1)[0])
            words = at + 8 + -(-n // 8) * 8
            directory = words + -(-n // 64) * 8
            entries = max(1, -(-n // BLOCK))
            self.levels.append((at + 8, words, directory, entries))
            at = directory + 8 * entries

    def _array(self, kind, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.ranges.read(at, n * np.dtype(kind).itemsize), kind, n)

    @property
    def doc_ids(self) -> list[int | None]:
        """The documents' ids in order."""
        null = self._array(np.uint8, self.after_ids, self.docs)
        return [None if x else int(d) for d, x in zip(self._array("<i8", 32, self.docs), null)]

    @property
    def starts(self) -> np.ndarray:
        """First token of each document, and the number of tokens."""
        return self._array("<u8", self.after_nulls, self.docs + 1).astype(np.int64)

    def _rank(self, level: int, i: int) -> int:
        """Ones before position i of a level's bitmap."""
        _, words, directory, entries = self.levels[level]
        block = min(i // BLOCK, entries - 1)
        first, whole = block * (BLOCK // 8), i // 8
        bits = self._array(np.uint8, words + first, whole - first + (1 if i % 8 else 0))
        n = int(self._array("<u8", directory + 8 * block, 1)[0]) + int(np.bitwise_count(bits[: whole - first]).sum())
        return n + (int(bits[-1]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else n

    def __getitem__(self, i: int) -> int:
        """Token i, by one rank for each level that it goes through."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift, level = 0, 0, 0
        while True:
            chunks, words, *_ = self.levels[level]
            value |= int(self._array(np.uint8, chunks + i, 1)[0]) << shift
            if not int(self._array(np.uint8, words + i // 8, 1)[0]) >> (i % 8) & 1:
                return value
            i, level, shift = self._rank(level, i), level + 1, shift + 8

    def slice(self, first: int, last: int) -> np.ndarray:
        """Tokens first to last (exclusive), by one rank a level."""
        value, where, shift = np.zeros(last - first, "<u4"), np.arange(last - first), 0
        for level, (chunks, words, *_) in enumerate(self.levels):
            if last <= first:
                break
            value[where] |= self._array(np.uint8, chunks + first, last - first).astype("<u4") << shift
            low = first // 8
            bits = np.unpackbits(self._array(np.uint8, words + low, -(-last // 8) - low), bitorder="little")[first - 8 * low : last - 8 * low].astype(bool)
            if not bits.any():
                break
            where = where[bits]
            first = self._rank(level, first)
            last, shift = first + len(where), shift + 8
        return value


def _open(path: str, mode: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    if mode == "w":
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(inner)
    return fs.open_input_file(inner)


def write(docs: DataFrame, vocabulary: str, out_dir: str | None = None, doc_id: str = "doc_id", text: str = "text",
          end_id: int | None = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode every row's whole text and write the files; the manifest (part, seq, path, n_docs, n_tokens, start) comes back.

    ``vocabulary`` is the path of a tokenizers file.  Ids are whole numbers or null, as the files hold 64-bit
    integers; a column of others is an error.  A null text is an empty one; null ids come first; rows of one
    id stand in order of their texts; no rows give no files.
    """
    spark = docs.sparkSession
    out_dir = out_dir or new_path(spark, "tokens")
    if "://" not in out_dir:
        out_dir = "file://" + out_dir.removeprefix("file:")
    shared = spark.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").cast("binary").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, worker = TaskContext.get().partitionId(), 0, encoder(shared.value)
        doc_ids, starts, held = [], [0], []

        def close() -> pa.RecordBatch:
            path = f"{out_dir}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            with _open(path, "w") as f:
                f.write(pack(doc_ids, starts, np.frombuffer(b"".join(held), "<u4")))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "n_docs": len(doc_ids), "n_tokens": starts[-1]}], pa.schema(
                [("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        gc.disable()  # the memos are many objects and no cycles
        try:
            for batch in batches:
                codes = (ids for group in _groups(body.as_py() for body in batch.column(1)) for ids in worker.encode(group))
                for name, ids in zip(batch.column(0).to_pylist(), codes):
                    held.append(ids + end)
                    doc_ids.append(name)
                    starts.append(starts[-1] + len(held[-1]) // 4)
                    if starts[-1] >= file_tokens:
                        yield close()
                        seq += 1
                        doc_ids, starts, held = [], [0], []
            worker.forget()
            if doc_ids:
                yield close()
        finally:
            gc.enable()

    files = stage(rows.mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long"), "manifest")
    # a total for each range: as many rows as the exchange has partitions
    before, so_far = [], 0
    for r in sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        before.append((r.part, so_far))
        so_far += r.n
    offsets = spark.createDataFrame(before, "part int, before long")
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return files.withColumn("inside", inside).join(F.broadcast(offsets), "part").select("part", "seq", "path", "n_docs", "n_tokens", (F.col("before") + F.col("inside")).alias("start"))


def read(manifest: DataFrame, value: Callable[[np.ndarray], object], name: str, kind: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens and ``value`` of its ids as column ``name``."""
    names = ["doc_id", "start", "n_tokens", name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"], "r") as f:
                    file = TokenFile(f)
                    cut, doc_ids, d = file.starts, file.doc_ids, 0
                    while d < file.docs:  # documents of some READ_TOKENS at a time, through the directory
                        e = max(d + 1, int(np.searchsorted(cut, cut[d] + READ_TOKENS, "right")) - 1)
                        at, ids = cut[d : e + 1], file.slice(int(cut[d]), int(cut[e]))
                        out = pa.array([value(ids[a:b]) for a, b in zip((at - at[0])[:-1], (at - at[0])[1:])])
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[d:e], pa.int64()), pa.array(at[:-1] + row["start"], pa.int64()), pa.array(np.diff(at), pa.int64()), out], names)
                        d = e

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("path", "start").repartition(n)  # a given number, or small rows would meet in one task
    return spread.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {kind}")


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
