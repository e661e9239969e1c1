"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of all training rows are summed in Spark as (language, bucket, n); the log-probability matrix,
``languages × buckets`` floats whatever the corpus, is broadcast, and batches are scored in numpy.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm.schemas import packed, quoted, restored, slices, unpacked, whole, with_fields

UNKNOWN = "und"
BUCKET_BITS = 14
PIECE = 1 << 17


def _letters() -> np.ndarray:
    """Whether each code point is a letter; made once in a Python worker."""
    keep = sys.modules.setdefault("_plait_worker", types.ModuleType("_plait_worker"))
    if not hasattr(keep, "letters"):
        keep.letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return keep.letters


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray], list[tuple[int, int]]]]:
    """Groups of lower-cased pieces of at most ``PIECE`` characters or so: row, codes, counted span.

    A long text comes in pieces with one character of context either side, so that memory is bounded and
    no n-gram is lost or counted twice.
    """
    rows, codes, spans, held = [], [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(low), PIECE):
            first, last = max(0, at - 1), min(len(low), at + PIECE + 1)
            rows.append(row)
            codes.append(low[first:last])
            spans.append((at - first, min(len(low), at + PIECE) - first))
            held += last - first
            if held >= PIECE:
                yield rows, codes, spans
                rows, codes, spans, held = [], [], [], 0
    if rows:
        yield rows, codes, spans


def grams(texts: list[str | None], bits: int = BUCKET_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, bucket) of the 1- to 3-grams of the texts, in groups; rows ascend in a group.

    1-grams are letters, 2-grams pairs of letters, 3-grams have a letter in the middle and whatever is no
    letter as a word border.
    """
    letters = _letters()
    for rows, codes, spans in _pieces(texts):
        length = np.array([len(c) + 1 for c in codes])
        start = np.cumsum(length) - length + 1
        flat = np.zeros(int(length.sum()) + 2, np.uint32)
        counted = np.zeros(len(flat), bool)
        for c, s, (lo, hi) in zip(codes, start, spans):
            flat[s : s + len(c)] = c
            counted[s + lo : s + hi] = True
        flat[~letters[flat]] = 0
        at = np.flatnonzero((flat != 0) & counted)
        owner = np.array(rows)[np.searchsorted(start, at, "right") - 1]
        one, before, after = (flat[at + d].astype(np.uint64) for d in (0, -1, 1))
        two = after != 0
        mixed = [one * np.uint64(0x9E3779B97F4A7C15),
                 (one[two] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after[two] * np.uint64(0x165667B19E3779F9)),
                 (before * np.uint64(0xD6E8FEB86659FD93)) ^ (one * np.uint64(0xA0761D6478BD642F)) ^ (after * np.uint64(0xE7037ED1A0B428DB))]
        mixed = [m ^ (m >> np.uint64(29)) for m in mixed]
        buckets = np.concatenate([(m * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits) for m in mixed]).astype(np.int64)
        owners = np.concatenate([owner, owner[two], owner])
        order = np.argsort(owners, kind="stable")
        yield owners[order], buckets[order]


class LanguageModel:
    """Learned languages (ascending), log-prior and log-probability matrix (buckets × languages)."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray, bits: int):
        self.langs, self.prior, self.logp, self.bits = langs, prior, logp, bits

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior of each text; ``und`` and 0.0 where no letter is."""
        total = np.zeros((len(texts), len(self.langs)))
        seen = np.zeros(len(texts), bool)
        for rows, buckets in grams(texts, self.bits):
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            if len(first):
                total[rows[first]] += np.add.reduceat(self.logp[buckets], first, axis=0, dtype=np.float64)
                seen[rows[first]] = True
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total += self.prior
        best = total.argmax(axis=1)
        top = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return ([self.langs[b] if s else UNKNOWN for b, s in zip(best, seen)],
                [float(t) if s else 0.0 for t, s in zip(top, seen)])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BUCKET_BITS, alpha: float = 0.5) -> LanguageModel:
    """Fit on every row with a text and a language.  No such row: a model that answers ``und``.

    What reaches the driver is ``languages × 2**bits`` sums at most.
    """
    rows = docs.select(quoted(text).cast("string").alias("text"), quoted(lang).cast("string").alias("lang")).where("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names, which = np.unique(np.array(langs, object), return_inverse=True)
            table = np.zeros((len(names), (1 << bits) + 1), np.int64)
            table[:, -1] = np.bincount(which, minlength=len(names))
            for row, bucket in grams(texts, bits):
                table += np.bincount(which[row] * table.shape[1] + bucket, minlength=table.size).reshape(table.shape)
            for name, add in zip(names, table):
                sums[name] = sums.get(name, 0) + add
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, buckets, n = (sums.column(i).to_numpy() for i in range(3))
    langs = sorted(set(names))
    table = np.zeros(((1 << bits) + 1, len(langs)))
    if langs:
        table[buckets, np.searchsorted(np.array(langs, object), names)] = n
    docs_in, table = table[-1], table[:-1] + alpha
    logp = np.log(table / table.sum(axis=0)).astype(np.float32) if langs else table.astype(np.float32)
    return LanguageModel(langs, np.log(docs_in / docs_in.sum()) if langs else docs_in, logp, bits)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language and its posterior, 0 to 1.

    Null texts and texts without a letter get ``und`` and 0.  Columns already named as ``into`` are replaced.
    """
    source = packed(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["rest", "text", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores = shared.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    out = source.mapInArrow(run, with_fields(source, ["rest", "text"], lang_pred="string", score="double"))
    kept = [c for c, name in zip(unpacked(docs, text), docs.columns) if name not in into]
    return out.select(*kept, F.col("lang_pred").alias(into[0]), F.col("score").alias(into[1]))


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0 (a null id counts as held out)."""
    return F.coalesce(F.crc32(quoted(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: float = 0.5) -> DataFrame:
    """Filter: rows whose language is known with a posterior of ``least`` or more, in the columns of ``docs``.

    The model learns from rows with a language, but those of ``held_out``; without any, all rows go.  Null
    texts and texts without a letter go; repeated rows are judged each; no rows give no rows.
    """
    model = train(docs.where(~held_out(doc_id)), text, lang)
    out = predict(docs.select(quoted(text).cast("string").alias("text"), whole(docs).alias("whole")), model)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*restored(docs, "whole"))
