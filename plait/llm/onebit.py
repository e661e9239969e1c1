"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Vectors that are equal are one class with its least ids.  Classes are dealt to lists by their nearest centre (fitted on a
bounded sample); what is left of a vector without its centre is rotated at random into at least ``bits``
dimensions, and the signs are its code.  With two numbers a code, how much of its direction the code keeps and the
length, the inner product with any query is estimated from the packed bits without bias, and its error has a known
width: the share of the direction that the code lost, spread evenly over the other dimensions.

A query visits every list that can hold one of its neighbours (by the longest remainder there, against the
neighbours it has in the sample).  There codes are compared in blocks; a vector is looked at itself only where
its estimate and ``sigmas`` widths reach what the query has found already, so the scores are those of the
vectors and only a vector that is off by more than so many widths is missed (about one in 30,000 of those at the limit).

Lists and queries of a list are cut into shares of bounded size, so a task holds one share of either however many vectors
fall into a list; each share returns the few best of each query.  A search goes in rounds over hash-drawn parts of the
classes, each some eight times the one before: what a round found bounds what the next returns to some eight times ``k`` a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plait.llm.schemas import quoted, with_fields
from plait.llm.vectors import usable
from plait.plans.staging import Scratch

#: Classes in a list on average, most lists, and sampled classes a list; the sample holds at most so many numbers.
LIST, LISTS, EACH, NUMBERS = 2048, 1024, 64, 1 << 22
#: How many times the classes of a round, at most, are those of the next.
GROWTH = 8
#: Classes and queries that a task compares; queries at a time.
SHARE, QUERIES, AT_ONCE = 16384, 4096, 256
SEED = 42


class Index:
    """What all tasks know: rotation, centres and the sample; its size is bounded by the length of a vector."""

    def __init__(self, sample: np.ndarray, lists: int, bits: int):
        rng = np.random.default_rng(SEED)
        width = sample.shape[1]
        self.bits = 8 * math.ceil(max(bits, width) / 8)
        self.rotation = np.linalg.qr(rng.standard_normal((self.bits, width)))[0].astype(np.float32)
        self.sample, self.centres = sample, self._fitted(sample, lists)

    @staticmethod
    def _fitted(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
        centres = sample[:lists].copy()
        for _ in range(rounds if lists > 1 else 1):
            where = _nearest(sample, centres)
            for c in np.unique(where):
                centres[c] = sample[where == c].mean(axis=0)
        return centres

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(list, packed signs, gain, width, length of the remainder) of each row."""
        where = _nearest(x, self.centres)
        left = x - self.centres[where]
        length = np.sqrt((left * left).sum(axis=1))
        turned = (left / np.where(length > 0, length, 1)[:, None]).astype(np.float32) @ self.rotation.T
        kept = np.abs(turned).sum(axis=1, dtype=float) / math.sqrt(self.bits)
        kept = np.where(length > 0, np.clip(kept, 1e-9, 1), 1)
        gain = length / (kept * math.sqrt(self.bits))
        wide = length * np.sqrt(1 / kept**2 - 1) / math.sqrt(max(self.bits - 1, 1))
        return where, np.packbits(turned > 0, axis=1), gain, wide, length


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, norms = np.empty(len(x), np.int32), (centres * centres).sum(axis=1) / 2
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = (norms - x[at : at + 8192] @ centres.T).argmin(axis=1)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, width)


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """``rows(id, v)`` → (v, ids): each vector with the ``k`` + 1 least ids that it has, null last."""
    key = F.struct(F.col("id").isNull().alias("none"), "id")
    firsts = rows.withColumn("key", key).withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("key"))).where(F.col("place") <= k + 1)
    return firsts.groupBy("v").agg(F.transform(F.array_sort(F.collect_list("key")), lambda x: x["id"]).alias("ids"))


def _index(classes: DataFrame, width: int, index: Index) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, codes, gain, wide, length = shared.value.encoded(_matrix(batch.column(0), width))
            bits = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where), bits, pa.array(gain), pa.array(wide), pa.array(length)], names)

    names = ["v", "ids", "list", "code", "gain", "wide", "length"]
    return classes.select("v", "ids").mapInArrow(run, with_fields(classes, ["v", "ids"], list="int", code="binary", gain="double", wide="double", length="double"))


def _probes(queries: DataFrame, width: int, index: Index, longest: dict[int, float], k: int) -> DataFrame:
    """``queries(q, v, floor)`` → (q, v, least, lists): a score that the last neighbour has at least, and the lists that may hold one.

    ``floor`` is such a score that is known already, or null.
    """
    shared = queries.sparkSession.sparkContext.broadcast((index, longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, longest = shared.value
        there = np.array(sorted(longest))
        reach = np.array([longest[e] for e in there.tolist()])
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                x = _matrix(part.column(1), width)
                least = np.full(len(x), -np.inf)
                if len(index.sample) > k:
                    least = np.partition(x @ index.sample.T, -(k + 1), axis=1)[:, -(k + 1)]
                    least -= 1e-9 * np.abs(least)
                least = np.fmax(least, part.column(2).to_numpy(zero_copy_only=False))
                most = x @ index.centres[there].T + np.sqrt((x * x).sum(axis=1))[:, None] * reach
                far = most * (1 + 1e-9 * np.sign(most)) < least[:, None]
                lists = pa.array([there[~f].astype(np.int32) for f in far], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(least), lists], ["q", "v", "least", "lists"])

    return queries.select("q", "v", "floor").mapInArrow(run, with_fields(queries, ["q", "v"], least="double", lists="array<int>"))


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of columns ``i`` of ``a`` and ``j`` of ``b``, each summed in the order of the components."""
    out = np.zeros(len(i))
    for x, y in zip(a, b):
        out += x[i] * y[j]
    return out


def _best(x: np.ndarray, codes: np.ndarray, gain: np.ndarray, wide: np.ndarray, centre: np.ndarray, queries: np.ndarray, least: np.ndarray, index: Index, k: int, sigmas: float):
    """(row of a query, row of a class, score): the best of each query in a share that may be among its neighbours."""
    signs = np.unpackbits(codes, axis=1, count=index.bits).astype(np.float32) * 2 - 1
    columns = np.ascontiguousarray(x.T)
    for at in range(0, len(queries), AT_ONCE):
        q = queries[at : at + AT_ONCE]
        norm = np.sqrt((q * q).sum(axis=1))
        unit, own = q / norm[:, None], np.ascontiguousarray(q.T)
        estimate = (unit @ centre)[:, None] + ((unit.astype(np.float32) @ index.rotation.T) @ signs.T) * gain
        floor = least[at : at + AT_ONCE].copy()
        top = min(k + 1, len(x))
        first = np.argpartition(estimate, len(x) - top, axis=1)[:, len(x) - top :]
        if top == k + 1:
            tried = _products(own, columns, np.repeat(np.arange(len(q)), top), first.ravel()).reshape(-1, top)
            floor = np.maximum(floor, tried.min(axis=1))
        # a rounding of the estimate counts as error, too
        i, j = np.nonzero(~(estimate + sigmas * wide + 1e-5 * (1 + np.abs(estimate)) * (1 + gain) < (floor / norm)[:, None]))
        score = _products(own, columns, i, j)
        near = ~(score < floor[i])
        yield i[near] + at, j[near], score[near]


def _found(index_rows: DataFrame, probes: DataFrame, width: int, index: Index, k: int, sigmas: float) -> DataFrame:
    """(q, score, ids): for each query and share of a list the best ``k`` + 1 classes at most."""
    shared = index_rows.sparkSession.sparkContext.broadcast(index)

    def run(key: tuple, classes: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], classes.schema.field("ids").type)})
        if not classes.num_rows or not queries.num_rows:
            return none
        classes, queries = classes.combine_chunks(), queries.combine_chunks()
        held = lambda t, c: pa.concat_arrays(t.column(c).chunks)
        x, asked = _matrix(held(classes, "v"), width), _matrix(held(queries, "v"), width)
        codes = np.frombuffer(b"".join(held(classes, "code").to_pylist()), np.uint8).reshape(len(x), -1)
        gain, wide, least = (np.asarray(held(t, c)) for t, c in ((classes, "gain"), (classes, "wide"), (queries, "least")))
        ids, q = held(classes, "ids"), held(queries, "q")
        first = [r[0] for r in ids.to_pylist()]
        rank = np.empty(len(x), np.int64)
        rank[sorted(range(len(x)), key=lambda r: (first[r] is None, first[r] if first[r] is not None else 0))] = np.arange(len(x))
        out = [none]
        for i, j, score in _best(x, codes, gain, wide, shared.value.centres[key[0].as_py()], asked, least, shared.value, k, sigmas):
            order = np.lexsort((rank[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, score = i[place <= k], j[place <= k], score[place <= k]
            out.append(pa.table({"q": q.take(pa.array(i)), "score": pa.array(score), "ids": ids.take(pa.array(j))}))
        return pa.concat_tables(out)

    kind = index_rows.schema["ids"].dataType.simpleString()
    by = ["list", "share", "turn"]
    return index_rows.groupBy(*by).cogroup(probes.groupBy(*by)).applyInArrow(run, f"q bigint, score double, ids {kind}")


def _shares(counts: dict[int, int], most: int) -> Column:
    """The number of shares of the list in column ``list``."""
    shares = [math.ceil(counts.get(e, 0) / most) or 1 for e in range(max(counts) + 1)]
    return F.get(F.array(*map(F.lit, shares)), F.col("list"))


def search(table: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", bits: int = 256, sigmas: float = 4.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its ``k`` nearest rows of ``table``, nearest first.

    Nearest is the largest inner product in double precision; ties go to the smaller id, null ids last.  A query's own
    row, one of its id, is left out; further rows of that id count like any other.  Vectors that are null, zero, hold
    null or non-finite components or are not of the table's commonest length take no part on either side, nor do
    queries with a null id.  Repeated queries are answered each; fewer than ``k`` others are all returned; no rows give none.
    """
    spark = table.sparkSession
    nonzero = F.exists("v", lambda x: x != 0)
    rows, width = usable(table, vec_id, embedding)
    kind = rows.schema["id"].dataType.simpleString()
    empty = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if not width:
        return spark.createDataFrame([], empty)
    asked, length = usable(queries, vec_id, embedding)
    if length and length != width:
        asked = asked.limit(0)
    asked = asked.where(nonzero).where("id is not null").withColumn("v", F.col("v").cast(rows.schema["v"].dataType))
    with Scratch(spark) as scratch:
        classes = scratch.stage(_classes(rows.where(nonzero), k), "classes")
        n = classes.count()
        if not n:
            return spark.createDataFrame([], empty)
        lists = min(LISTS, max(1, n // LIST))
        share = min(EACH * lists + 16 * (k + 1), max(k + 1, NUMBERS // width)) / n
        drawn = classes.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).orderBy(F.xxhash64("v"), "v").select("v").collect()
        if not drawn:
            drawn, lists = classes.select("v").limit(1).collect(), 1
        index = Index(np.array([r.v for r in drawn], float), min(lists, len(drawn)), bits)
        rounds = 1 + max(0, math.ceil(math.log(n / len(drawn), GROWTH)) - 1)
        # the last round has all but an eighth of the classes, the one before all but an eighth of that, and so on
        u = F.pmod(F.xxhash64(F.lit(SEED), "v"), F.lit(1 << 40)) / float(1 << 40)
        turn = sum((F.when(u >= GROWTH ** -float(r), 1).otherwise(0) for r in range(1, rounds)), F.lit(0)).cast("int")
        coded = scratch.stage(_index(classes, width, index).withColumn("round", turn), "codes")
        sizes = {(r.round, r.list): r for r in coded.groupBy("round", "list").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()}
        distinct = scratch.stage(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
        each = F.transform("ids", lambda x: F.struct((-F.col("score")).alias("far"), x.isNull().alias("none"), x.alias("id")))
        best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0].isNull(), F.col("ids")[0]))
        whole = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        floor, found, top = distinct.withColumn("floor", F.lit(None).cast("double")), None, None
        for r in range(rounds):
            own = {e: x for (at, e), x in sizes.items() if at == r}
            if not own:
                continue
            probes = _probes(floor, width, index, {e: x.longest for e, x in own.items()}, k).withColumn("list", F.explode("lists")).drop("lists")
            probes = scratch.stage(probes, "probes")
            turns = {x.list: x.n for x in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}
            if not turns:
                continue
            of, by_turn = _shares({e: x.n for e, x in own.items()}, SHARE), _shares({e: turns.get(e, 0) for e in own}, QUERIES)
            left = coded.where((F.col("round") == r) & F.col("list").isin(list(turns))).withColumn("share", F.pmod(F.hash("v"), of)).withColumn("turn", whole(by_turn)).drop("length", "round")
            right = probes.withColumn("turn", F.pmod(F.hash("q"), by_turn)).withColumn("share", whole(of))
            new = scratch.stage(_found(left, right, width, index, k, sigmas), "found")
            found = new if found is None else found.unionByName(new)
            near = found.withColumn("place", best).where(F.col("place") <= k + 1).groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k + 1).alias("near"))
            top = scratch.stage(near, "near")
            last = F.when(F.size("near") > k, -F.col("near")[k]["far"])
            floor = distinct.join(top.hint("merge"), "q", "left").select("q", "v", last.alias("floor"))
        if top is None:
            return spark.createDataFrame([], empty)
        answers = scratch.keep(distinct.join(top.hint("merge"), "q").select("v", "near"), "answers")
    own = F.coalesce(F.array_position(F.transform("near", lambda x: x["id"]), F.col("id")), F.lit(0))
    others = F.slice(F.filter("near", lambda x, i: i + 1 != own), 1, k)
    out = asked.join(answers.hint("merge"), "v").select("id", F.posexplode(others).alias("place", "n"))
    return out.select(F.col("id").alias("query_id"), (F.col("place") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.far")).alias("score"))


def every(table: DataFrame, n: int, vec_id: str = "vec_id") -> DataFrame:
    """The rows whose id ``n`` divides: the queries of a search."""
    return table.where(quoted(vec_id) % n == 0)
