"""Correction of signatures by one small network per column.

A column's network predicts its symbol from all others of the (extended) signature.  Training rows are a
bounded sample; columns are the parallel axis; inference streams all signatures through all networks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.functions.bases import BASES
from plait.operators.reads import flanks, stable_symbols
from plait.plans.staging import stage

MODEL = "v int, w0 array<double>, b0 array<double>, w1 array<double>, b1 array<double>, accuracy double"
TRAIN_ROWS = 4000
#: Columns whose networks run in one product.
NET_BLOCK = 64


def one_hot(sigs: list[str], width: int) -> np.ndarray:
    """Rows × (5 width), blank all zeros."""
    codes = np.frombuffer("".join(s.ljust(width)[:width] for s in sigs).encode("latin1", "replace"), np.uint8).reshape(len(sigs), width)
    return np.stack([codes == ord(b) for b in BASES], axis=2).reshape(len(sigs), 5 * width).astype(np.float32)


def forward(x: np.ndarray, net: tuple, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Hidden and output activations: tanh and sigmoid, or sigmoid and softmax."""
    w0, b0, w1, b1 = net
    h = x @ w0 + b0
    h = np.tanh(h) if kind == "tanh" else 1 / (1 + np.exp(-h))
    z = h @ w1 + b1
    if kind == "tanh":
        return h, 1 / (1 + np.exp(-z))
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return h, z / z.sum(axis=1, keepdims=True)


def train_net(x: np.ndarray, y: np.ndarray, kind: str, hidden: int, rounds: int, batch: int, rate: float, dropout: float, seed: int, start: tuple | None = None, stop: float = 97.0) -> tuple[tuple, float]:
    """Mini-batch Adam on the quadratic cost (tanh) or cross entropy (softmax) with weight decay; the best net seen and its accuracy in percent.

    A tanh net is best by accuracy and stops at ``stop`` percent.  A softmax net is best by its mean quadratic cost, decay included; the rate
    halves after a round that lowers the cost by 0.001 or less, and it stops below a cost of 0.05 with over 96 percent
    right, unless all its answers are the same.
    """
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    decay = 1.0 / n if kind == "tanh" else 1.0 / n**2
    net = [a.copy() for a in start] if start else [rng.normal(0, n**-0.5, (n, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 5)), np.zeros(5)]
    m, v = [np.zeros_like(a) for a in net], [np.zeros_like(a) for a in net]
    truth = y.argmax(axis=1)

    def judged() -> tuple[float, float, bool]:  # percent right, cost, whether no more training is needed
        out = forward(x, net, kind)[1]
        told = out.argmax(axis=1)
        right = float((told == truth).mean() * 100)
        cost = float(((out - y) ** 2).sum(axis=1).mean() / 2 + decay * ((net[0] ** 2).sum() + (net[2] ** 2).sum()) / 2 / len(x))
        return right, cost, right >= stop if kind == "tanh" else cost < 0.05 and right > 96 and len(np.unique(told)) > 1

    (best, low, enough), kept = judged(), [a.copy() for a in net]
    before, step = low, 0
    for _ in range(rounds):
        if enough:
            break
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            part = order[at : at + batch]
            xb = x[part] * (rng.random((len(part), n)) >= dropout) / (1 - dropout) if dropout else x[part]
            h, o = forward(xb, net, kind)
            d = (o - y[part]) / len(part)
            if kind == "tanh":
                d = d * o * (1 - o)
            dh = d @ net[2].T * ((1 - h * h) if kind == "tanh" else h * (1 - h))
            grads = [xb.T @ dh + decay * net[0] / len(x), dh.sum(axis=0), h.T @ d + decay * net[2] / len(x), d.sum(axis=0)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net[k] = net[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        right, cost, enough = judged()
        if (right > best) if kind == "tanh" else (cost < low):
            best, low, kept = right, cost, [a.copy() for a in net]
        if kind == "softmax" and before < cost + 0.001:
            rate /= 2
        before = cost
    return tuple(kept), best


def train(sigs: DataFrame, width: int, columns: range, flank: int = 0, kind: str = "tanh", hidden: int | None = None, rounds: int = 30, batch: int = 50, rate: float = 0.01,
          seed: int = 7, most_rows: int = TRAIN_ROWS, models: DataFrame | None = None, stop: float = 97.0) -> DataFrame:
    """``sigs(sig_id, sig)``, extended by ``flank`` either side → a network for each column of ``columns``.

    Learns from ``most_rows`` signatures or so, drawn by a hash of the id.  With ``models``, weak networks are
    trained further from where they are.  Rows that do not cover a column do not train its network; a column
    that none covers has zero weights.
    """
    spark = sigs.sparkSession
    full, hidden = width + 2 * flank, hidden or (5 if kind == "tanh" else 10)
    total = sigs.count()
    share = min(1.0, most_rows / max(1, total))
    rows = sigs.where((F.pmod(F.xxhash64(F.col("sig_id").cast("string")), F.lit(1 << 20)) + 0.5) / (1 << 20) <= share).orderBy("sig_id").select("sig").toPandas()["sig"].tolist()
    old = {r.v: r for r in models.collect()} if models is not None else {}
    shared = spark.sparkContext.broadcast((rows, old))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, before = shared.value
        v = int(pdf["v"].iloc[0])
        hot = one_hot(texts, full) if texts else np.zeros((0, 5 * full), np.float32)
        at = 5 * (v + flank)
        y = hot[:, at : at + 5].astype(float)
        seen = y.sum(axis=1) > 0.5
        x = np.delete(hot, slice(at, at + 5), axis=1)[seen].astype(float)
        start = None
        if v in before:
            r = before[v]
            start = (np.array(r.w0).reshape(-1, len(r.b0)), np.array(r.b0), np.array(r.w1).reshape(len(r.b0), 5), np.array(r.b1))
        if not seen.any():
            n = 5 * (full - 1)
            net, acc = start or (np.zeros((n, hidden)), np.zeros(hidden), np.zeros((hidden, 5)), np.zeros(5)), 0.0
        else:
            net, acc = train_net(x, y[seen], kind, hidden, rounds, batch, rate, 0.5 if kind == "softmax" else 0.0, seed + v, start, stop)
        return pd.DataFrame([[v, net[0].ravel(), net[1], net[2].ravel(), net[3], acc]], columns=["v", "w0", "b0", "w1", "b1", "accuracy"])

    todo = spark.createDataFrame([(v,) for v in columns], "v int").repartition(max(1, len(columns)), "v")
    return todo.groupBy("v").applyInPandas(fit, MODEL)


def _side_by_side(models: DataFrame, flank: int, exact: bool) -> list[tuple]:
    """Columns, and their networks' weights as one matrix and stacks, ``NET_BLOCK`` at a time."""
    nets = {r.v: (np.array(r.w0).reshape(-1, len(r.b0)), np.array(r.b0), np.array(r.w1).reshape(len(r.b0), 5), np.array(r.b1)) for r in models.toLocalIterator()}
    blocks = []  # a column's own symbol weighs nothing in its network
    for first in range(0, len(nets), NET_BLOCK):
        part = sorted(nets)[first : first + NET_BLOCK]
        w0 = np.concatenate([np.insert(nets[v][0], [5 * (v + flank)] * 5, 0, axis=0) for v in part], axis=1).astype(float if exact else np.float32)
        blocks.append((np.array(part), w0, np.concatenate([nets[v][1] for v in part]), np.stack([nets[v][2] for v in part]), np.stack([nets[v][3] for v in part])))
    return blocks


def predict(sigs: DataFrame, models: DataFrame, width: int, flank: int = 0, kind: str = "tanh", mask: bool = True, exact: bool = False) -> DataFrame:
    """``sigs`` with each column of ``sig`` (its middle ``width``) replaced by its network's answer; blanks stay with ``mask``.

    The networks, whose size the width alone sets, are broadcast.  ``exact`` works in doubles throughout.
    """
    full = width + 2 * flank
    shared = sigs.sparkSession.sparkContext.broadcast(_side_by_side(models, flank, exact))
    letters = np.array(list(BASES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                texts = [(s or "").ljust(full)[:full] for s in part.column(1).to_pylist()]
                hot = one_hot(texts, full)
                own = np.array([list(t[flank : flank + width]) for t in texts]).reshape(len(texts), width)
                for columns, w0, b0, w1, b1 in shared.value:
                    h = hot @ w0 + b0
                    h = (np.tanh(h) if kind == "tanh" else 1 / (1 + np.exp(-h))).reshape(len(texts), len(columns), -1)
                    # the greatest answer is that of the greatest sum, before the sigmoid or softmax
                    new = letters[(np.einsum("rkh,khc->rkc", h, w1) + b1).argmax(axis=2)]
                    own[:, columns] = np.where(own[:, columns] == " ", " ", new) if mask else new
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(["".join(r) for r in own])], ["sig_id", "sig"])

    return sigs.select("sig_id", "sig").mapInArrow(run, f"sig_id {sigs.schema['sig_id'].dataType.simpleString()}, sig string")


def _sums(sigs: DataFrame, models: DataFrame, width: int, flank: int, kind: str) -> DataFrame:
    """(v, layer, unit, total, n) over the signatures that cover a column, which may be added up.

    Layers 0 and 1 are the sums of hidden and output activations; layer 2 has the quadratic cost, the right answers, and
    for each symbol how often it is the truth (units 2 to 6) and the answer (7 to 11).
    """
    full = width + 2 * flank
    shared = sigs.sparkSession.sparkContext.broadcast(_side_by_side(models, flank, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added: dict[int, list] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                texts = [(s or "") for s in batch.column(0).slice(first, 1024).to_pylist()]
                hot = one_hot(texts, full).astype(float)
                for columns, w0, b0, w1, b1 in shared.value:
                    h = hot @ w0 + b0
                    h = (np.tanh(h) if kind == "tanh" else 1 / (1 + np.exp(-h))).reshape(len(texts), len(columns), -1)
                    z = np.einsum("rkh,khc->rkc", h, w1) + b1
                    z = 1 / (1 + np.exp(-z)) if kind == "tanh" else np.exp(z - z.max(axis=2, keepdims=True))
                    z = z if kind == "tanh" else z / z.sum(axis=2, keepdims=True)
                    y = hot.reshape(len(texts), full, 5)[:, columns + flank]
                    seen = y.sum(axis=2) > 0.5
                    told = np.eye(5)[z.argmax(axis=2)] * seen[:, :, None]
                    facts = [((z - y) ** 2).sum(axis=2) / 2 * seen, (told * y).sum(axis=2)]
                    last = np.concatenate([np.stack(facts, axis=2).sum(axis=0), y.sum(axis=0), told.sum(axis=0)], axis=1)
                    made = [(h * seen[:, :, None]).sum(axis=0), (z * seen[:, :, None]).sum(axis=0), last]
                    for k, v in enumerate(columns.tolist()):
                        old = added.get(v, [0, 0, 0, 0])
                        added[v] = [old[0] + seen[:, k].sum(), *[o + m[k] for o, m in zip(old[1:], made)]]
        rows = [(v, layer, unit, float(x), int(n)) for v, (n, *layers) in added.items() for layer, units in enumerate(layers) for unit, x in enumerate(units)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()))], ["v", "layer", "unit", "total", "n"])

    parts = sigs.select("sig").mapInArrow(run, "v int, layer int, unit int, total double, n bigint")
    return parts.groupBy("v", "layer", "unit").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def activations(sigs: DataFrame, models: DataFrame, width: int, flank: int = 0, kind: str = "tanh") -> DataFrame:
    """(v, layer, unit, n, mean): the mean activation of each hidden (layer 0) and output unit (1) of each column's network.

    Over the ``n`` signatures that cover the column; a column that none covers has null means.  Null signatures cover
    none; no signatures give no rows.
    """
    sums = _sums(sigs, models, width, flank, kind).where("layer < 2")
    return sums.select("v", "layer", "unit", "n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"))


def accuracy(sigs: DataFrame, models: DataFrame, width: int, flank: int = 0, kind: str = "tanh", decay: float = 0.0) -> DataFrame:
    """(v, n, cost, correct, targets, answers): each network's mean cost, percent right (one decimal, cut off) and histograms.

    The cost is half the squared error plus ``decay`` times the squares of all weights and biases; histograms are arrays
    of counts in the order ``acgt-``.  Columns that no signature covers have nulls and zeros.
    """
    squares = lambda c: F.aggregate(F.transform(c, lambda x: x * x), F.lit(0.0), lambda a, b: a + b)
    weights = models.select("v", (decay * (squares("w0") + squares("w1") + squares("b0") + squares("b1"))).alias("decay"))
    units = F.array_sort(F.collect_list(F.struct("unit", "total")))  # twelve of a network
    sums = _sums(sigs, models, width, flank, kind).where("layer = 2").groupBy("v").agg(F.max("n").alias("n"), F.transform(units, lambda x: x["total"]).alias("t"))
    out = sums.join(weights, "v")
    whole = lambda first: F.transform(F.slice("t", first, 5), lambda x: x.cast("long"))
    given = F.col("n") > 0
    return out.select("v", "n", F.when(given, F.col("t")[0] / F.col("n") + F.col("decay")).alias("cost"), F.when(given, F.floor(F.col("t")[1] * 1000 / F.col("n")) / 10).alias("correct"),
                      whole(3).alias("targets"), whole(8).alias("answers"))


def assess(sigs: DataFrame, models: DataFrame, width: int, exact: bool = False) -> DataFrame:
    """``sigs(sig_id, sig)`` → (v, truth, predicted, n): how often a column's network answers what for which symbol; blanks do not count."""
    answers = predict(sigs, models, width, exact=exact).withColumnRenamed("sig", "new")
    both = sigs.select("sig_id", "sig").join(answers, "sig_id")
    cells = both.select(F.posexplode(F.arrays_zip(F.split("sig", "").alias("truth"), F.split("new", "").alias("predicted"))).alias("v", "x"))
    return cells.select("v", "x.truth", "x.predicted").where("truth != ' '").groupBy("v", "truth", "predicted").agg(F.count("*").alias("n"))


def correct(sigs: DataFrame, models: DataFrame, width: int, rounds: int = 5, kind: str = "tanh", mask: bool = True, lag: int = 1, sizes: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(corrected, first pass): ``rounds`` of prediction, then symbols that still change go back to the original.

    What a round leaves as it was stays so, as a signature's answers depend on it alone; so only signatures that
    changed go into the next round, and the rounds stop when none does.  ``sizes``, a list, is given the number of signatures of
    each round.  Ids are unique; null signatures become blanks without ``mask``, with it they stay blank.
    """
    begun = sigs.select("sig_id", F.rpad(F.coalesce("sig", F.lit("")), F.lit(width), F.lit(" ")).alias("sig"))
    now, kept, first = stage(begun, "round"), [begun.withColumn("round", F.lit(0))], None
    for k in range(1, rounds + 1):
        new = stage(predict(now, models, width, kind=kind, mask=mask).join(now.withColumnRenamed("sig", "old"), "sig_id"), "round")
        first = first if first is not None else new.select("sig_id", "sig")
        now = new.where(F.col("sig") != F.col("old")).select("sig_id", "sig")
        kept.append(now.withColumn("round", F.lit(k)))
        left = now.count()
        if sizes is not None:
            sizes.append(left)
        if not left:
            break
    return _settled_changes(kept, rounds, lag), first


def _settled(seen: list[DataFrame], rounds: int, lag: int) -> DataFrame:
    """The last round's signatures, symbols that still change as they were at first."""
    every = seen[0]
    for s in seen[1:]:
        every = every.unionByName(s)
    cells = every.select("sig_id", "round", F.posexplode(F.split("sig", "")).alias("v", "base"))
    return stable_symbols(cells, rounds, lag).groupBy("sig_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "base"))), lambda x: x["base"]), "").alias("sig"))


def _settled_changes(kept: list[DataFrame], rounds: int, lag: int) -> DataFrame:
    """As ``_settled`` of signatures that are kept for the rounds that changed them only."""
    every = kept[0]
    for s in kept[1:]:
        every = every.unionByName(s)
    until = lambda k: F.max_by("sig", F.when(F.col("round") <= k, F.col("round")))
    at = every.groupBy("sig_id").agg(until(0).alias("first"), until(rounds - lag).alias("before"), until(rounds).alias("last"))
    symbols = F.arrays_zip(*[F.split(c, "").alias(c) for c in ("first", "before", "last")])
    return at.select("sig_id", F.array_join(F.transform(symbols, lambda x: F.when(x["last"] == x["before"], x["last"]).otherwise(x["first"])), "").alias("sig"))


def extended(items: DataFrame, flank: int, width: int, patterns: dict[str, str] | None = None) -> DataFrame:
    """``items(read_id, y, klass, sig_id, sig)`` → (sig_id, sig) of elements with a signature, with their flanks."""
    ext = flanks(items, ["y"], flank, width, patterns)
    return items.where("sig_id is not null").select("read_id", "y", "sig_id").join(ext, ["read_id", "y"]).select("sig_id", F.col("ext").alias("sig"))


def correct_reads(items: DataFrame, models: DataFrame, width: int, flank: int, patterns: dict[str, str] | None = None, rounds: int = 5, kind: str = "tanh", mask: bool = True, lag: int = 1) -> tuple[DataFrame, DataFrame]:
    """As ``correct`` for signatures in read lists: each round sees the flanks that the round before left."""
    rest = items.select("read_id", "y", "klass", "sig_id")
    now, seen, first = items, [items.where("sig_id is not null").select("sig_id", "sig").withColumn("round", F.lit(0))], None
    for k in range(1, rounds + 1):
        new = stage(predict(extended(now, flank, width, patterns), models, width, flank, kind, mask), "round")
        first = first or new
        seen.append(new.withColumn("round", F.lit(k)))
        now = rest.join(new, "sig_id", "left")
    return _settled(seen, rounds, lag), first
