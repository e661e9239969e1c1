import numpy as np
from pyspark.sql import functions as F

from plait.plans.assembly import assemble, copy_consensus, lay_out, layer_report, report, segments_of_reads
from plait.sources import simulate
from plait.streaming import profiles


def test_reads_to_corrected_signatures(spark):
    copies = simulate.copies(spark, 240, 4, 24, seed=11).cache()
    reads = simulate.reads(copies, 25, seed=2, rates=(0.02, 0.02, 0.02)).cache()
    template = copies.orderBy("copy_id").first().seq
    out = assemble(spark, reads.select(F.col("read_id").alias("seg_id"), "seq"), template, sweeps=1, min_distance=5, min_size=10, min_shared=20, sigmas=4, least_z=5, rounds=2, training=40)
    assert out.columns.count() >= 2
    truth = reads.select(F.col("read_id").alias("sig_id"), "copy_id")
    before, after = report(out.signatures, out.signatures, truth, low=5).first(), report(out.signatures, out.corrected, truth, low=5).first()
    assert after.accuracy >= before.accuracy > 0.8
    assert copy_consensus(out.signatures, truth, out.columns.count()).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    q = profiles.class_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, profiles.class_counts(events).collect()))


def test_from_raw_reads_to_layers(spark):
    """Reads over a row of four copies are cut, aligned, corrected, clustered and layered; the layers are the copies."""
    copies = simulate.copies(spark, 300, 4, 40, seed=5).orderBy("copy_id").collect()
    template, genome = copies[0].seq, "".join(c.seq for c in copies)
    rows = [(8 * s + k, s * 300, genome[s * 300 :]) for s in range(2) for k in range(16)]
    rows = [(i, start, simulate.noisy(seq, np.random.default_rng([3, i]), (0.01, 0.01, 0.01))) for i, (_, start, seq) in enumerate(rows)]
    reads = spark.createDataFrame(rows, "read_id long, start long, seq string")
    segs = segments_of_reads(reads, template, 10, 0.3).cache()
    assert sorted(r["count"] for r in segs.groupBy("read_id").count().collect()) == [3] * 16 + [4] * 16
    out = assemble(spark, segs.select("seg_id", "seq"), template, sweeps=0, min_distance=5, min_size=8, min_shared=16, sigmas=3, least_z=4, rounds=1, training=20)
    width = out.columns.count()
    assert width >= 4
    layout = lay_out(spark, segs, out.classes, out.corrected, width, least=3)
    truth = segs.join(reads, "read_id").select("seg_id", (F.col("start") / 300 + F.col("pos")).cast("long").alias("copy_id"))
    assert layout.layers.select("layer").distinct().count() >= 3
    assert layer_report(layout, truth).first().percent > 80
