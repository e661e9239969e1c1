"""The chain from reads to a report, as one function per stage and one for all.

Each stage takes and gives DataFrames; stages that are read more than once are kept: by default written to the shared
folder until the driver ends, by ``run`` as named tables of a catalogue, from which an interrupted chain goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.functions.bases import cut_at, template_parts
from plait.operators import align, associate, cluster, consensus, evaluate, graph, learn, profile, reads
from plait.plans.catalogue import Catalogue, fingerprint, key_of
from plait.plans.staging import stage

#: Keeps what the function makes under a name.
Keep = Callable[[str, Callable[[], DataFrame]], DataFrame]


def staged(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    return stage(make(), name)


def segments_of_reads(reads_df: DataFrame, template: str, parts: int = 20, cutoff: float = 0.30, overlap: int = 0) -> DataFrame:
    """``reads_df(read_id, seq)`` → (seg_id, read_id, pos, seq): reads cut where copies of the template end.

    The template's parts are found in each read; candidates come from its two last and two first parts, and each
    next cut is about a template's length after the one before.  Reads without a cut are one segment; null reads go.
    """
    spark, length = reads_df.sparkSession, len(template) // parts
    whole = spark.createDataFrame([(template,)], "seq string")
    pieces = whole.select(F.inline(template_parts(F.col("seq"), parts, overlap))).select("part", F.col("seq").alias("pattern"))
    known = stage(reads_df.where("seq is not null").select("read_id", "seq"), "reads")
    # ``parts`` rows of one template on the small side
    pairs = known.select("read_id", F.col("seq").alias("text")).crossJoin(F.broadcast(pieces))
    hits = stage(align.occurrences(pairs, cutoff), "hits")
    candidates = reads.cut_candidates(hits, known.select("read_id", F.length("seq").alias("size")), parts, length)
    chain = reads.cut_chain(candidates, len(template))
    cuts = chain.groupBy("read_id").agg(F.array_sort(F.collect_list(F.col("cut").cast("int"))).alias("cuts"))
    cut = known.join(cuts, "read_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    pieces = cut.select("read_id", F.inline(cut_at(F.col("seq"), F.col("cuts"))))
    return reads.global_number(pieces, ["read_id", "pos"], "seg_id").select("seg_id", "read_id", "pos", "seq")


@dataclass
class Layout:
    """What the second half leaves: clusters of signatures, their graph and layers."""

    members: DataFrame
    centroids: DataFrame
    edges: DataFrame
    layers: DataFrame


def lay_out(spark: SparkSession, segments: DataFrame, classes: DataFrame, signatures: DataFrame, width: int, patterns: dict[str, str] | None = None, percent: int = 10, least: int = 10, keep: Keep = staged) -> Layout:
    """``segments(seg_id, read_id, pos)``, ``classes(seg_id, klass)``, ``signatures(sig_id, sig)`` → clusters and their layers.

    Signatures, extended over their whole reads, are clustered in two rounds around those covered at both edges and
    one of each class but ``r``; clusters that follow one another in reads are layered from the one that stands first.
    """
    def joined() -> DataFrame:
        items = segments.join(classes.select("seg_id", "klass"), "seg_id").join(signatures.withColumnRenamed("sig_id", "seg_id"), "seg_id", "left")
        return items.select("read_id", F.col("pos").alias("y"), "klass", F.col("seg_id").alias("sig_id"), "sig")

    items = keep("items", joined)
    flank = width * 3
    full = width + 2 * flank

    def extended() -> DataFrame:
        wide = reads.flanks(items, ["y"], flank, width, patterns).join(items.select("read_id", "y", "sig_id"), ["read_id", "y"])
        return wide.select("sig_id", "klass", F.col("ext").alias("sig"))

    wide = keep("extended", extended)
    seeds = keep("seeds", lambda: cluster.seed_centroids(wide, cluster.coverage_extent(wide, full, percent).first()[0] or 1))
    centroids = keep("centroids", lambda: cluster.centroids_of(wide.select("sig_id", "sig"), seeds, full))
    members = keep("members", lambda: cluster.nearest_centroid(wide.select("sig_id", "sig"), centroids))
    nodes = members.select("sig_id", "cluster_id").join(items.select("sig_id", "read_id", "y"), "sig_id").select(F.col("read_id").alias("x"), "y", "cluster_id")
    edges = keep("edges", lambda: graph.edges(nodes))

    def layered() -> DataFrame:
        start = evaluate.start_cluster(nodes.select("cluster_id", "y"), least).first()
        placed = graph.layers_of(edges, [start.cluster_id] if start else [])
        return spark.createDataFrame(list(placed.items()), "cluster_id long, layer long")

    return Layout(members, centroids, edges, keep("layers", layered))


def layer_report(layout: Layout, truth: DataFrame) -> DataFrame:
    """``truth(seg_id, copy_id)`` → one row: percent of the placed segments that are in their layer's commonest copy."""
    placed = layout.members.join(layout.layers, "cluster_id").select("layer", F.col("sig_id").alias("seg_id"))
    return evaluate.placed_percent(evaluate.purity(placed, truth))


@dataclass
class Assembly:
    """What the stages leave."""

    classes: DataFrame
    alignment: DataFrame
    columns: DataFrame
    signatures: DataFrame
    corrected: DataFrame


def assemble(spark: SparkSession, segments: DataFrame, template: str, cutoff: float = 0.30, band: int = 1000, sweeps: int = 3, min_distance: int = 60, min_size: int = 100, min_shared: int = 100,
             sigmas: float = 7.0, most_columns: int = 300, least_z: float = 12, rounds: int = 5, training: int = 30, keep: Keep = staged) -> Assembly:
    """``segments(seg_id, seq)`` of one family: classify, align, realign, choose columns, correct the signatures.

    No column above ``least_z`` gives empty signatures, which stay as they are.
    """
    classes = keep("classes", lambda: align.classify(segments, template, cutoff))

    def traced() -> DataFrame:
        inside = segments.join(classes.where("klass = 'r' and strand = 1").select("seg_id"), "seg_id", "left_semi").select(F.col("seg_id").alias("row_id"), F.col("seq").alias("kept"), "seq", F.lit(template).alias("template"))
        return align.traces(inside, "seq", "template").select("row_id", F.col("kept").alias("seq"), "trace")

    traces = keep("traces", traced)
    star = keep("star", lambda: profile.blank_terminal_gaps(align.star_alignment(traces)))

    def aligned() -> DataFrame:
        width = (star.agg(F.max("col")).first()[0] or -1) + 1
        rows = profile.to_wide(star, max(1, width))
        return profile.blank_terminal_gaps(profile.to_long(align.realign_rows(rows, band, sweeps) if sweeps else rows))

    msa = keep("alignment", aligned)

    def chosen() -> DataFrame:
        pairs = associate.scan(msa, min_distance=min_distance, min_size=min_size, min_shared=min_shared, sigmas=sigmas)
        return associate.select_columns(associate.column_significance(pairs), most_columns, least_z)

    columns = keep("columns", chosen)
    n = columns.count()
    sigs = keep("signatures", lambda: profile.to_wide(profile.project_columns(msa, columns), max(1, n)).select(F.col("row_id").alias("sig_id"), F.col("row").alias("sig")))
    if n < 2:
        return Assembly(classes, msa, columns, sigs, sigs)
    models = keep("models", lambda: learn.train(sigs, n, range(n), rounds=training))
    return Assembly(classes, msa, columns, sigs, keep("corrected", lambda: learn.correct(sigs, models, n, rounds=rounds)[0]))


@dataclass
class Run:
    """What the whole chain leaves; the report is None without a truth."""

    segments: DataFrame
    assembly: Assembly
    layout: Layout
    report: DataFrame | None


def run(spark: SparkSession, root: str, reads_df: DataFrame, template: str, truth: Callable[[DataFrame], DataFrame] | None = None, cutting: dict | None = None, assembling: dict | None = None, laying: dict | None = None) -> Run:
    """The whole chain: ``reads_df(read_id, seq)`` → segments, assembly, layers and, with a truth, one report.

    Every stage is a named table of the catalogue at ``root``, keyed by the reads, the template, the parameters and the
    stages before it.  A chain that was interrupted, or is run again, reads what is there and makes the rest; a changed
    parameter makes its own stage and those after it anew.  ``truth`` gives (seg_id, copy_id) of the segments.
    """
    catalogue = Catalogue(spark, root)
    key = [key_of(fingerprint(reads_df.select("read_id", "seq")), template)]

    def keep(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key[0] = key_of(key[0], name)
        return catalogue.step(name, key[0], make)

    def after(part: str, parameters: dict | None) -> dict:
        key[0] = key_of(key[0], part, {k: repr(v) for k, v in (parameters or {}).items()})
        return parameters or {}

    cutting = after("cutting", cutting)
    segments = keep("segments", lambda: segments_of_reads(reads_df, template, **cutting))
    assembling = after("assembling", assembling)
    made = assemble(spark, segments.select("seg_id", "seq"), template, keep=keep, **assembling)
    laying = after("laying", laying)
    layout = lay_out(spark, segments, made.classes, made.corrected, max(1, made.columns.count()), keep=keep, **laying)
    if truth is None:
        return Run(segments, made, layout, None)
    known = truth(segments).select(F.col("seg_id").alias("row_id"), "copy_id")
    cells = lambda sigs: sigs.select(F.col("sig_id").alias("row_id"), F.posexplode(F.split("sig", "")).alias("col", "base"))
    placed = layout.members.join(layout.layers, "cluster_id").select(F.col("sig_id").alias("row_id"), "cluster_id", "layer")
    after("truth", {"rows": fingerprint(known)})
    return Run(segments, made, layout, keep("report", lambda: evaluate.report(cells(made.signatures), cells(made.corrected), known, placed)))


def report(raw: DataFrame, corrected: DataFrame, truth: DataFrame, **band) -> DataFrame:
    """Correction statistics of signatures against ``truth(sig_id, copy_id)``."""
    def cells(sigs: DataFrame) -> DataFrame:
        return sigs.join(truth, "sig_id").select(F.col("copy_id").alias("grp"), F.col("sig_id").alias("row_id"), F.posexplode(F.split("sig", "")).alias("col", "base")).where("base != ' '")
    return evaluate.correction_stats(cells(raw), cells(corrected), **band)


def copy_consensus(sigs: DataFrame, truth: DataFrame, width: int) -> DataFrame:
    """(grp, consensus) of the signatures of each copy."""
    cells = sigs.join(truth, "sig_id").select(F.col("copy_id").alias("grp"), F.posexplode(F.split("sig", "")).alias("col", "base"))
    return consensus.consensus(cells, width)
