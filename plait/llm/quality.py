"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  Votes are summed to counts of vote
patterns (3 to the power of the labellers at most), on which expectation-maximisation estimates each
labeller's vote probabilities given the class, and so a posterior for each pattern.  A bounded sample of
documents with these soft labels trains a logistic scorer over hashed words, which scores every whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm.schemas import quoted, slices, with_fields
from plait.plans.staging import Scratch

BITS = 15
SAMPLE = 3000
BINS = 1000
_SYMBOLS = b"#$%&*|<>{}[]~^=_@\\"
_MARKS = _SYMBOLS + b"!?.,;:-+/()'\"`"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_DIGITS = b"0123456789"


def _vote(value: float, bad_above: float, good_below: float) -> int:
    return -1 if value > bad_above else 1 if value < good_below else 0


def votes(text: bytes | None) -> tuple[int, ...]:
    """Votes of the labellers: 1 good, -1 bad, 0 none.  A text without words is bad to the first and nothing to the rest."""
    words = text.split() if text else []
    if not words:
        return (-1,) + (0,) * (len(LABELLERS) - 1)
    n, m = len(text), len(words)
    count = lambda some: n - len(text.translate(None, some))
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = Counter(words)
    upper, lower, ends = count(_UPPER), count(_LOWER), text.count(b".") + text.count(b"!") + text.count(b"?")
    enough = m >= 20
    return (
        -1 if m < 20 else 1 if m > 80 else 0,
        _vote(count(_SYMBOLS) / n, 0.02, 0.002),
        _vote(count(_DIGITS) / n, 0.05, 0.004),
        _vote(1 - len(set(lines)) / len(lines), 0.25, 0.02 if len(lines) > 3 else 0),
        -1 if ends * 60 < m else 1 if ends * 25 > m else 0,
        _vote(seen.most_common(1)[0][1] / m, 0.2, 0.12) if enough else 0,
        _vote(upper / max(1, upper + lower), 0.3, 0.08),
        -1 if not 2.5 < (n - m + 1) / m < 12 else 0,
        _vote(count(_MARKS) / n, 0.07, 0.045),
        _vote((text.count(b"!!") + text.count(b"??")) / m, 0.1, 0.01),
        _vote(sum(map(eq, words, words[1:])) / m, 0.2, 0.03) if enough else 0,
        _vote(sum(not w.rstrip(b".,;:!?").isalpha() and w.isascii() for w in words) / m, 0.3, 0.05),
    )


LABELLERS = ("length", "symbols", "digits", "repeated_lines", "sentence_ends", "one_word", "capitals", "word_length", "marks", "shouting", "stuttering", "no_words")


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pattern rows of votes and their counts → posterior of "good" by pattern, vote table (labeller, class, vote + 1), class shares.

    Starts from the majority; classes keep their meaning because each labeller is better than chance on it.
    """
    total = counts.sum()
    good = 1 / (1 + np.exp(-patterns.sum(axis=1, dtype=float)))
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        soft = np.stack([1 - good, good], axis=1) * counts[:, None]
        share = (soft.sum(axis=0) + smooth) / (total + 2 * smooth)
        table = np.einsum("pc,plv->lcv", soft, hot) + smooth
        table /= table.sum(axis=2, keepdims=True)
        score = np.log(share) + np.einsum("plv,lcv->pc", hot, np.log(table))
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
    return good, table, share


def accuracies(table: np.ndarray, share: np.ndarray) -> np.ndarray:
    """How often each labeller is right where it votes, by the estimates."""
    right = share[0] * table[:, 0, 0] + share[1] * table[:, 1, 2]
    voted = np.einsum("c,lcv->l", share, table[:, :, [0, 2]])
    return right / voted


def buckets(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Hashed lower-case words of a text."""
    words = text.lower().split() if text else []
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) >> (32 - bits)


def fit(features: list[np.ndarray], soft: np.ndarray, bits: int = BITS, rounds: int = 150, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on mean-of-words features, by full-batch Adam; weights and bias."""
    unique = [np.unique(f, return_counts=True) for f in features]
    index = np.concatenate([u for u, _ in unique]) if unique else np.zeros(0, np.int64)
    value = np.concatenate([n / n.sum() for _, n in unique if len(n)]) if len(index) else np.zeros(0)
    row = np.repeat(np.arange(len(unique)), [len(u) for u, _ in unique])
    w, m, v = (np.zeros((1 << bits) + 1) for _ in range(3))
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[index], minlength=len(unique)) + w[-1]
        error = (1 / (1 + np.exp(-z)) - soft) / max(1, len(unique))
        g = np.append(np.bincount(index, value * error[row], minlength=1 << bits), error.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return w[:-1], float(w[-1])


def _string(v: tuple[int, ...]) -> str:
    return "".join("-0+"[x + 1] for x in v)


def _voted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([_string(votes(t.as_py())) for t in batch.column(0)], pa.string())], ["votes"])

    return docs.select("text").mapInArrow(run, "votes string")


def cut_of(counts: dict[int, int], share: float) -> float:
    """The least value that is kept, where ``counts`` has rows by bin of ``BINS``: the highest that leaves ``share`` of them or more."""
    total, kept = sum(counts.values()), 0
    for k in sorted(counts, reverse=True):
        kept += counts[k]
        if kept >= share * total - 1e-9:
            return k / BINS
    return 0.0


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, least: float | None = None) -> DataFrame:
    """doc_id, votes, posterior (of the votes), score (of the words), keep and accuracies (of ``LABELLERS``) of every row.

    The scorer learns from ``sample`` documents or so, drawn by a hash of their ids; all statistics of votes are
    those of all documents.  ``keep`` is whether the mean of posterior and score reaches ``least``; by default the
    highest thousandth that keeps the estimated share of good documents, of all documents.  A null or empty text
    has no words: its score is the bias's.  Repeated rows are scored each; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).cast("string").cast("binary").alias("text"))
    counted = sorted(_voted(rows).groupBy("votes").agg(F.count("*").alias("n")).collect())  # patterns of votes: 3**12 at most, whatever the rows
    names = [r.votes for r in counted]
    pattern = np.array([["-0+".index(v) - 1 for v in name] for name in names]).reshape(len(names), len(LABELLERS))
    n = np.array([r.n for r in counted], float)
    good, table, shares = expectation_maximisation(pattern, n)
    right = accuracies(table, shares).tolist()
    posterior = dict(zip(names, good.tolist()))
    share = min(1.0, sample / max(1.0, n.sum()))
    drawn = rows.where((F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(1 << 20)) + 0.5) / (1 << 20) < share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.as_py() for t in batch.column(1)]
            hot = [np.unique(buckets(t), return_counts=True) for t in texts]
            labels = [_string(votes(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([u.astype(np.int32) for u, _ in hot], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in hot], pa.list_(pa.int32())), pa.array(labels, pa.string())], ["b", "c", "votes"])

    learned = [r for r in drawn.mapInArrow(features, "b array<int>, c array<int>, votes string").collect() if r.b]
    learned.sort(key=lambda r: (r.votes, r.b, r.c))
    weights, bias = fit([np.repeat(np.array(r.b), np.array(r.c)) for r in learned], np.array([posterior.get(r.votes, 0.5) for r in learned]))
    shared = spark.sparkContext.broadcast((posterior, weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w, b = shared.value
        for batch in slices(batches):
            labels, scores = [], []
            for t in batch.column(1):
                body = t.as_py()
                labels.append(_string(votes(body)))
                at = buckets(body)
                scores.append(1 / (1 + np.exp(-(w[at].mean() + b if len(at) else b))))
            post = [known.get(v, 0.5) for v in labels]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(post, pa.float64()), pa.array(scores, pa.float64())], ["doc_id", "votes", "posterior", "score"])

    with Scratch(spark) as scratch:
        scored = scratch.keep(rows.mapInArrow(run, with_fields(rows, ["doc_id"], votes="string", posterior="double", score="double")), "scores")
    mean = (F.col("posterior") + F.col("score")) / 2
    if least is None:
        least = cut_of({r.bin: r.n for r in scored.groupBy(F.floor(mean * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()}, float(shares[1]))
    return scored.select("*", (mean >= least).alias("keep"), F.array(*map(F.lit, right)).alias("accuracies"))
