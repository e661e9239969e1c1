import pytest
from pyspark.sql import functions as F

from plait.operators import evaluate
from plait.plans import assembly
from plait.plans.catalogue import Catalogue, fingerprint


def test_tables_by_name(spark, tmp_path):
    c = Catalogue(spark, f"file://{tmp_path}/tables here")
    assert c.names() == [] and c.manifest("a") is None
    with pytest.raises(KeyError):
        c.load("a")
    with pytest.raises(ValueError):
        c.save("../a", spark.range(1))
    c.save("a", spark.range(3), "k")
    c.save("b", spark.createDataFrame([], "x int, y array<string>"))
    assert c.load("a").count() == 3 and c.names() == ["a", "b"] and c.load("b").dtypes == [("x", "int"), ("y", "array<string>")]
    # a table made from its older self
    c.save("a", c.load("a").withColumn("y", F.lit(1)))
    assert c.load("a").columns == ["id", "y"] and len(list((tmp_path / "tables here/tables").glob("a-*"))) == 1
    assert Catalogue(spark, f"file://{tmp_path}/tables here").load("a").count() == 3
    c.remove("a")
    c.remove("a")
    assert c.names() == ["b"]


def test_what_is_not_committed_is_not_there(spark, tmp_path):
    c = Catalogue(spark, f"file://{tmp_path}")
    c.save("a", spark.range(3), "old")
    with pytest.raises(Exception, match="no such thing"):
        c.save("a", spark.range(5).select(F.raise_error(F.lit("no such thing"))), "new")
    assert c.load("a").count() == 3 and c.manifest("a")["key"] == "old"
    assert c.step("a", "old", lambda: pytest.fail("made again")).count() == 3
    assert c.step("a", "new", lambda: spark.range(9)).count() == 9 and c.made == ["a"]


def test_fingerprint(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert fingerprint(a) == fingerprint(a.orderBy(F.desc("i"))) != fingerprint(a.limit(1))
    assert fingerprint(a) != fingerprint(a.withColumnRenamed("s", "t")) and fingerprint(a) != fingerprint(a.unionByName(a))


def test_chain_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    import numpy as np

    from plait.sources import simulate

    copies = simulate.copies(spark, 300, 4, 40, seed=5).orderBy("copy_id").collect()
    template, genome = copies[0].seq, "".join(c.seq for c in copies)
    rows = [(8 * s + k, s * 300, genome[s * 300 :]) for s in range(2) for k in range(16)]
    rows = [(i, start, simulate.noisy(seq, np.random.default_rng([3, i]), (0.01, 0.01, 0.01))) for i, (_, start, seq) in enumerate(rows)]
    reads = spark.createDataFrame(rows, "read_id long, start long, seq string")

    def truth(segments):
        return segments.join(reads.select("read_id", "start"), "read_id").select("seg_id", (F.col("start") / 300 + F.col("pos")).cast("long").alias("copy_id"))

    settings = {"cutting": {"parts": 10}, "assembling": {"sweeps": 0, "min_distance": 5, "min_size": 8, "min_shared": 16, "sigmas": 3, "least_z": 4, "rounds": 1, "training": 20}}
    made, root = [], f"file://{tmp_path}"
    step = Catalogue.step
    monkeypatch.setattr(Catalogue, "save", lambda self, name, *a, f=Catalogue.save: (made.append(name), f(self, name, *a))[1])

    # the driver dies at the first table of the second half
    monkeypatch.setattr(Catalogue, "step", lambda self, name, *a: step(self, name, *a) if name != "items" else (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        assembly.run(spark, root, reads, template, truth, laying={"least": 3}, **settings)
    first = ["segments", "classes", "traces", "star", "alignment", "columns", "signatures", "models", "corrected"]
    assert made == first
    monkeypatch.setattr(Catalogue, "step", step)
    out = assembly.run(spark, root, reads, template, truth, laying={"least": 3}, **settings)
    second = ["items", "extended", "seeds", "centroids", "members", "edges", "layers", "report"]
    assert made == first + second
    report = sorted(map(tuple, out.report.collect()), key=str)
    placed = out.report.where("level = 'layer'").agg(F.sum("right"), F.sum("placed")).first()
    assert placed[0] > 0.8 * placed[1] > 0
    # run again: all is there; another parameter of the last part makes that part only
    again = assembly.run(spark, root, reads, template, truth, laying={"least": 3}, **settings)
    assert made == first + second and sorted(map(tuple, again.report.collect()), key=str) == report
    assembly.run(spark, root, reads, template, truth, laying={"least": 4}, **settings)
    assert made == first + 2 * second


def test_report_by_hand(spark):
    # copies 0 to 3 of which 0 and 3 stand at the ends; two columns
    raw = {0: "aa", 1: "aa", 2: "ac", 3: "ac", 4: "ag", 5: "ca", 6: "cc", 7: "c ", 8: "aa"}
    new = {**raw, 4: "ac", 7: "ca"}
    copy = {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2, 8: 3}
    members = [(1, 10, 1), (2, 10, 1), (5, 10, 1), (3, 11, 1), (6, 12, 0), (7, 12, 0), (4, None, 1)]
    cells = lambda d: spark.createDataFrame([(i, c, b) for i, s in d.items() for c, b in enumerate(s)], "row_id long, col int, base string")
    got = evaluate.report(cells(raw), cells(new), spark.createDataFrame(list(copy.items()), "row_id long, copy_id long"), spark.createDataFrame(members, "row_id long, cluster_id long, layer long"))
    got = {(r.level, r.id): r.asDict() for r in got.collect()}
    one = got["copy", 1]
    # consensus of copy 1: a, c; of copy 2: c, a, with the corrected rows c, a
    assert (one["cells"], one["errors"], one["cells_after"], one["errors_after"], one["unlike_after"]) == (8, 2, 8, 1, 1)
    two = got["copy", 2]
    assert (two["cells"], two["errors"], two["cells_after"], two["errors_after"], two["columns"], two["collapsed"]) == (5, 1, 6, 1, 2, 0)
    # one copy has either consensus, so none is rarer than another
    assert one["minor"] == two["minor"] == 0
    assert got["copy", 0]["cells"] == 0 and ("copy", 3) in got
    layer = got["layer", 1]
    assert (layer["placed"], layer["right"], layer["in_place"], layer["copy_id"]) == (4, 3, 3, 1)
    other = got["layer", 0]
    assert (other["placed"], other["right"], other["in_place"], other["copy_id"]) == (2, 2, 0, 2)
    assert (got["cluster", 10]["placed"], got["cluster", 10]["right"]) == (3, 2)
