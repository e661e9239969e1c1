"""Layering of cluster graphs: edges one and two places on, placement scores, greedy layers."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.functions.bases import masked_hamming
from plait.operators.reads import adjacency

#: ``layering`` answers with a list of so many at most; ``layers_of`` takes any number.
MOST_CLUSTERS = 5000


def edges(items: DataFrame) -> DataFrame:
    """``items(x, y, cluster_id)`` → (c1, c2, hop, weight) for hops 1 and 2."""
    return adjacency(items, 1).withColumn("hop", F.lit(1)).unionByName(adjacency(items, 2).withColumn("hop", F.lit(2))).select("c1", "c2", "hop", "weight")


def layer_scores(edge: DataFrame, layers: DataFrame, layer: int, double: float = 2.0, penalty: float = 1.0, centroids: DataFrame | None = None, fraction: float = 1.0, cap: int | None = None) -> DataFrame:
    """(cluster_id, score): the score of placing each unplaced cluster into ``layer``; -1 without a fitting edge.

    ``layers(cluster_id, layer)``, -1 unplaced.  An edge to where it should lead counts its weight (twice for
    two-place edges), any other edge to a placed cluster costs as much; distance to the layer's centroids costs.
    """
    placed = layers.where("layer >= 0")
    ahead = edge.join(placed.withColumnRenamed("cluster_id", "c2"), "c2").select(F.col("c1").alias("cluster_id"), (F.col("layer") - F.col("hop") == layer).alias("fits"), "hop", "weight")
    behind = edge.join(placed.withColumnRenamed("cluster_id", "c1"), "c1").select(F.col("c2").alias("cluster_id"), (F.col("layer") + F.col("hop") == layer).alias("fits"), "hop", "weight")
    worth = F.col("weight") * F.when(F.col("hop") == 2, double).otherwise(1.0)
    per = ahead.unionByName(behind).groupBy("cluster_id").agg(F.sum(F.when(F.col("fits"), worth).otherwise(0.0)).alias("good"), F.sum(F.when(F.col("fits"), 0.0).otherwise(worth)).alias("bad"))
    out = layers.where("layer = -1").select("cluster_id").join(per, "cluster_id", "left").na.fill(0.0, ["good", "bad"])
    if centroids is not None:
        mates = layers.where(F.col("layer") == layer).join(centroids, "cluster_id").select(F.col("sig").alias("mate"))
        far = masked_hamming(F.col("sig"), F.col("mate"))
        far = far if cap is None else F.least(far, F.lit(cap))
        apart = out.join(centroids, "cluster_id").crossJoin(F.broadcast(mates)).groupBy("cluster_id").agg((F.sum(far) / fraction).alias("apart"))  # a layer's clusters
        out = out.join(apart, "cluster_id", "left").na.fill(0.0, ["apart"])
    else:
        out = out.withColumn("apart", F.lit(0.0))
    return out.select("cluster_id", F.when(F.col("good") < 1, -1.0).otherwise(F.col("good") - penalty * F.col("bad") - F.col("apart")).alias("score"))


def layers_of(edge: DataFrame, starts: Iterable[int], start_layer: int = 0, double: float = 2.0, penalty: float = 1.0, difference: Callable[[int, int], float] | None = None, fraction: float = 1.0,
              sizes: dict[int, float] | None = None, most_size: float | None = None, most_layer: float | None = None) -> dict[int, int]:
    """Layer of each cluster that can be placed: from ``starts`` in ``start_layer``, the best placement at a time until none scores 0 or more.

    No layer is below 0, and a cluster goes only where its layer or one beside it holds clusters.  Of equal scores
    the first cluster and then the lowest layer wins.  ``most_size`` and ``most_layer`` leave out large clusters and
    full layers.  The driver holds the edges, and after each placement only scores that it changes are worked out.
    """
    links: dict[int, list[tuple[int, int, float]]] = defaultdict(list)  # cluster: (other, layers from the other to it, weight)
    for r in edge.toLocalIterator():
        if r.c1 != r.c2:
            weight = r.weight * (double if r.hop == 2 else 1.0)
            links[r.c1].append((r.c2, -r.hop, weight))
            links[r.c2].append((r.c1, r.hop, weight))
    layer: dict[int, int] = {}
    held: dict[int, list[int]] = defaultdict(list)
    good: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))  # cluster: layer: weight that wants it there
    total: dict[int, float] = defaultdict(float)
    wanting: dict[int, set[int]] = defaultdict(set)
    version: dict[int, int] = defaultdict(int)
    heap: list[tuple[float, int, int, int]] = []

    def offer(c: int) -> None:
        """The best place of ``c`` as it now is."""
        version[c] += 1
        if most_size is not None and sizes is not None and sizes.get(c, 0) >= most_size:
            return
        best = None
        for x, g in good[c].items():
            if x < 0 or g < 1 or not (held.get(x) or held.get(x - 1) or held.get(x + 1)):
                continue
            if most_layer is not None and sizes is not None and sum(sizes.get(k, 0) for k in held.get(x, ())) >= most_layer:
                continue
            score = g - penalty * (total[c] - g) - (sum(difference(c, k) for k in held.get(x, ())) / fraction if difference else 0.0)
            best = min(best, (-score, x)) if best else (-score, x)
        if best and best[0] <= 0:
            heapq.heappush(heap, (best[0], c, best[1], version[c]))

    def put(c: int, x: int) -> set[int]:
        layer[c] = x
        held[x].append(c)
        changed = {k for y in (x - 1, x, x + 1) for k in wanting[y]}
        for other, step, weight in links[c]:  # where the others stand as seen from them
            if other not in layer:
                good[other][x - step] += weight
                total[other] += weight
                wanting[x - step].add(other)
                changed.add(other)
        return {k for k in changed if k not in layer}

    changed = set()
    for c in starts:
        changed |= put(c, start_layer)
    for c in changed - layer.keys():
        offer(c)
    while heap:
        _, c, x, made = heapq.heappop(heap)
        if c in layer or made != version[c]:
            continue
        for k in put(c, x):
            offer(k)
    return layer


def layering(edge: DataFrame, start: int | list[int], n_clusters: int, double: float = 2.0, penalty: float = 1.0, differences: np.ndarray | None = None, fraction: float = 1.0,
             sizes: np.ndarray | None = None, most_size: float | None = None, most_layer: float | None = None, start_layer: int = 0) -> list[int]:
    """``layers_of`` as a list for clusters 0 to ``n_clusters`` - 1, -1 unplaced; an edge to any other is an error."""
    if n_clusters > MOST_CLUSTERS:
        raise ValueError(f"{n_clusters} clusters; lists have {MOST_CLUSTERS}, layers_of takes any number")
    if not edge.where((F.col("c1") >= n_clusters) | (F.col("c2") >= n_clusters) | (F.col("c1") < 0) | (F.col("c2") < 0)).isEmpty():
        raise ValueError(f"edges beyond {n_clusters} clusters")
    found = layers_of(edge, [start] if isinstance(start, int) else start, start_layer, double, penalty, None if differences is None else lambda a, b: float(differences[a, b]), fraction,
                      None if sizes is None else dict(enumerate(np.asarray(sizes).tolist())), most_size, most_layer)
    return [found.get(c, -1) for c in range(n_clusters)]
