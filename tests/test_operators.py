"""Micro-fixtures and plain-Python checks of what SQL does not cover."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plait.functions import bases as B
from plait.operators import align, associate, cluster, consensus, evaluate, graph, indel, learn, profile, reads
from plait.sources import simulate, text


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def edit_last_row(p, t):
    row = [0] * (len(t) + 1)
    for c in p:
        new = [row[0] + 1]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return row


def test_blank_is_no_gap(spark):
    msa = profile.to_long(spark.createDataFrame([(0, "ac-t "), (1, " c-t "), (2, "ag-t ")], "row_id long, row string"))
    assert rows_of(profile.column_profile(msa)) == [(0, "a", 2), (1, "c", 2), (1, "g", 1), (2, "-", 3), (3, "t", 3)]
    cells = msa.withColumn("grp", F.lit(1))
    assert consensus.consensus(cells, 5).first().consensus == "ac-t "
    assert consensus.consensus(cells, 5, empty="a").first().consensus == "ac-ta"
    assert profile.sum_of_pairs(msa).first().score == 4
    assert rows_of(profile.to_wide(msa, 5)) == [(0, "ac-t "), (1, " c-t "), (2, "ag-t ")]


def test_ties_and_strictness(spark):
    cells = spark.createDataFrame([(1, 0, b) for b in "ccaa"] + [(1, 1, "g")] * 11 + [(1, 1, "t")] * 5, "grp int, col int, base string")
    assert consensus.consensus(cells, 2).first().consensus == "ag"
    assert consensus.consensus(cells, 2, "last").first().consensus == "cg"
    assert consensus.consensus(cells, 2, "strict").first().consensus == "xg"


def test_reverse_complement_and_parts(spark):
    df = spark.createDataFrame([("acgtt",), ("acgt",), ("",)], "s string")
    out = [r[0] for r in df.select(B.reverse_complement(F.col("s"))).collect()]
    assert out == ["aacgt", "acgt", ""]
    assert [r[0] for r in df.select(B.reverse_complement(B.reverse_complement(F.col("s")))).collect()] == ["acgtt", "acgt", ""]
    parts = spark.createDataFrame([("abcdefghij",)], "s string").select(F.inline(B.template_parts(F.col("s"), 5, 2))).collect()
    assert [(r.part, r.start, r.seq) for r in parts] == [(0, 0, "abcd"), (1, 2, "cdef"), (2, 4, "efgh"), (3, 6, "ghij"), (4, 8, "ijab")]
    assert [tuple(r) for r in spark.createDataFrame([("abcdef", [2, 5])], "s string, c array<int>").select(F.inline(B.cut_at(F.col("s"), F.col("c")))).collect()] == [(0, "ab"), (1, "cde"), (2, "f")]


def test_semi_global_known_and_random():
    assert align.semi_global("gattaca", "ccgatacagg")[0] == 1
    rng = random.Random(1)
    for _ in range(60):
        p, t = ("".join(rng.choice("acgt") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = edit_last_row(p, t)
        assert align.last_row(p, t).tolist() == row
        assert align.semi_global(p, t) == (min(row), max(j for j, x in enumerate(row) if x == min(row)))
        dist, places = align.trace(p, t)
        used = [x for x in places if x >= 0]
        assert dist == min(row) and used == sorted(set(used)) and len(places) == len(p)
        inside = (used[-1] - used[0] + 1 - len(used)) if used else 0
        assert dist == sum(x < 0 for x in places) + sum(p[i] != t[x] for i, x in enumerate(places) if x >= 0) + inside


def test_overlap():
    assert align.overlap("ttttacgtacgt", "acgtacgtgggg", 5) == 0.0
    assert align.overlap("acgt", "ttacgttt", 4) == 0.0
    assert align.overlap("aaaa", "cccc", 3) == 1.0
    assert align.overlap("ac", "ac", 5) is None


def test_star_alignment_and_realign(spark):
    template = "acgtacgtac"
    seqs = {0: "acgtacgtac", 1: "acgttacgtac", 2: "gtacac", 3: "cgtagtac"}
    traced = align.traces(spark.createDataFrame([(k, s, s, template) for k, s in seqs.items()], "row_id long, kept string, seq string, template string"), "seq", "template").select("row_id", F.col("kept").alias("seq"), "trace")
    msa = align.star_alignment(traced)
    width = msa.agg(F.max("col")).first()[0] + 1
    wide = {r.row_id: r.row for r in profile.to_wide(msa, width).collect()}
    assert width >= 11 and {k: w.replace("-", "").strip() for k, w in wide.items()} == seqs
    rows = spark.createDataFrame([(1, k, w) for k, w in wide.items()] + [(2, 9, "ac gt")], "family int, row_id long, row string")
    before = profile.sum_of_pairs(msa).first().score
    out = align.realign(rows, 5, 10).where("family = 1")
    after = profile.sum_of_pairs(profile.to_long(out.select("row_id", "row"))).first().score
    assert after <= before and {r.row_id: r.row.replace("-", "").strip() for r in out.collect()} == seqs


def test_occurrences_and_classify(spark):
    pairs = spark.createDataFrame([(1, 0, "gattaca", "ccgattacaccccccgatacacc"), (2, 0, "gattaca", "")], "read_id long, part long, pattern string, text string")
    assert rows_of(align.occurrences(pairs, 0.3)) == [(1, 0, 9, 0), (1, 0, 21, 1)]
    template = "acgtgtccatgaccatgtta"
    segs = spark.createDataFrame([(0, "gtgtccatgacc"), (1, "ggtcatggacac"), (2, "aaaaaaaaaaaa")], "seg_id long, seq string")
    got = {r.seg_id: (r.strand, r.klass) for r in align.classify(segs, template).collect()}
    assert got[0] == (1, "r") and got[1] == (-1, "r") and got[2][1] == "l"


def test_islands_cuts_and_oscillation(spark):
    pts = spark.createDataFrame([(1, y, float(v)) for y, v in enumerate([9, 1, 1, 9, 2, 9, 9, 9, 9, 0])], "read_id int, y int, value double")
    isl = reads.island_minima(pts, ["y"], 5)
    assert rows_of(isl) == [(1, 0, 2, 1.0, 2), (1, 1, 1, 2.0, 4), (1, 2, 1, 0.0, 9)]
    assert rows_of(reads.merge_close(isl, 4)) == [(1, 2, 1.0), (1, 9, 0.0)]
    hits = spark.createDataFrame([(1, p) for p in (120, 160, 190, 300, 900)] + [(2, 500)], "read_id int, pos int")
    assert rows_of(reads.cut_chain(hits, 100)) == [(1, 0, 120), (1, 1, 190), (1, 2, 300)]


def test_flanks_of_short_reads(spark):
    items = spark.createDataFrame([(1, 0, "No", "ac"), (2, 0, "No", "gt"), (2, 1, "Li", None), (2, 2, "No", "ca")], "read_id int, y int, klass string, sig string")
    got = {(r.read_id, r.y): r.ext for r in reads.flanks(items, ["y"], 3, 2, {"Li": "x"}).collect()}
    assert got == {(1, 0): "   ac   ", (2, 0): "   gtxxc", (2, 1): " gtxxca ", (2, 2): "txxca   "}


def test_flanks_of_signed_elements_only(spark):
    items = spark.createDataFrame([(2, 0, "No", "gt"), (2, 1, "Li", None), (2, 2, "No", "ca"), (3, 0, "Li", None)], "read_id int, y int, klass string, sig string")
    got = {(r.read_id, r.y): r.ext for r in reads.flanks(items, ["y"], 3, 2, {"Li": "x"}, signed=True).collect()}
    assert got == {(2, 0): "   gtxxc", (2, 2): "txxca   "}
    assert reads.flanks(items.limit(0), ["y"], 3, 2, signed=True).count() == 0


def test_first_cut(spark):
    pts = spark.createDataFrame([(1, 5, "p"), (1, 10, "q"), (1, 11, "r"), (2, 1, "s")], "k int, pos int, name string")
    cuts = spark.createDataFrame([(1, 10), (1, 7)], "k int, cut int")
    assert {r.name: r.cut for r in reads.first_cut_at_or_after(pts, cuts, ["k"]).collect()} == {"p": 7.0, "q": 10.0, "r": None, "s": None}


def test_tails(spark):
    got = spark.createDataFrame([(0, 10, 10, 100), (5, 10, 10, 100), (900, 1000, 1000, 100000)], "k long, a long, b long, c long").select(associate.hypergeometric_tail(*map(F.col, "kabc"))).collect()
    assert round(got[0][0], 6) == round(-math.log10(math.comb(90, 10) / math.comb(100, 10)), 6) and 3 < got[1][0] < 4 and got[2][0] == 99.0


def test_no_significant_column(spark):
    msa = spark.createDataFrame([(r, c, "a") for r in range(5) for c in range(5)], "row_id long, col int, base string")
    pairs = associate.scan(msa, min_distance=1, min_size=1, min_shared=1)
    assert associate.select_columns(associate.column_significance(pairs)).count() == 0


def test_planted_association_is_found(spark):
    rng = random.Random(4)
    cells = []
    for r in range(300):
        x = rng.random() < 0.5
        cells += [(r, 0, "a" if x else "c"), (r, 80, "g" if x else "t"), (r, 160, rng.choice("ac"))]
    cols = associate.column_significance(associate.scan(spark.createDataFrame(cells, "row_id long, col int, base string")))
    assert [r.col for r in associate.select_columns(cols).collect()] == [0, 80]


def test_nearest_centroid_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("acgt- ") for _ in range(n))
    sigs, cents = [(i, make(20)) for i in range(60)], [(k, make(20)) for k in range(9)]
    want = [(i, *min((sum(a != b and " " not in (a, b) for a, b in zip(s, c)), k) for k, c in cents)) for i, s in sigs]
    a, b = spark.createDataFrame(sigs, "sig_id long, sig string"), spark.createDataFrame(cents, "cluster_id long, sig string")
    for size in (10**6, 45):
        monkeypatch.setattr(cluster, "BLOCK_CHARS", size)
        assert rows_of(cluster.nearest_centroid(a, b).select("sig_id", "diff", "cluster_id")) == want
    assert cluster.nearest_centroid(a, b.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, j) for g in ([1, 2, 3], [5, 6]) for i in g for j in g], "i long, j long")
    assert rows_of(cluster.shared_neighbour_components(links)) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]


def test_layering(spark):
    items = spark.createDataFrame([(x, y, c) for x in range(6) for y, c in enumerate([2, 0, 3, 1])], "x int, y int, cluster_id int")
    assert graph.layering(graph.edges(items), 2, 5) == [1, 3, 0, 2, -1]
    with pytest.raises(ValueError):
        graph.layering(graph.edges(items), 0, graph.MOST_CLUSTERS + 1)


def test_networks_correct_planted_errors(spark):
    rng = random.Random(6)
    kinds = ["acgtacgtacgt", "ccgtaagtacta", "acctacgaacgg"]
    truth = {i: kinds[i % 3] for i in range(240)}
    noisy = {i: "".join(rng.choice("acgt") if rng.random() < 0.08 else c for c in s) for i, s in truth.items()}
    noisy[0] = " " + noisy[0][1:]
    sigs = spark.createDataFrame(list(noisy.items()), "sig_id long, sig string")
    for kind, mask in (("tanh", True), ("softmax", False)):
        models = learn.train(sigs, 12, range(12), rounds=60, kind=kind, stop=101)
        again = learn.train(sigs, 12, range(12), rounds=2, kind=kind, models=models, stop=101)
        assert again.join(models.select("v", F.col("accuracy").alias("old")), "v").where("accuracy < old").count() == 0
        final, _ = learn.correct(sigs, models, 12, rounds=3, kind=kind, mask=mask)
        wrong = lambda d: sum(a != b for i, s in d.items() for a, b in zip(s, truth[i]) if a != " ")
        fixed = {r.sig_id: r.sig for r in final.collect()}
        assert wrong(fixed) < 0.5 * wrong(noisy) and (fixed[0][0] == " ") == mask


def test_indel_windows(spark):
    base = "acgtgtcatgacgtacctga" * 3
    rows = [(i, base) for i in range(12)] + [(20 + i, base[:20] + "-" * 12 + base[32:]) for i in range(8)]
    got = rows_of(indel.detect(spark.createDataFrame(rows, "sig_id long, sig string"), 0, 60, 40, 20, 10, 5))
    assert got == [(w, 20 + i) for w in (0, 20) for i in range(8)]


def test_formats_round_trip(spark, tmp_path):
    (tmp_path / "r.fasta").write_text(">one x\nACGT\nac_gn\n>two\nTT\n>three\n" + "acgt" * 60)
    got = [tuple(r) for r in text.fasta(spark, f"{tmp_path}/r.fasta").orderBy("read_id").collect()]
    assert got == [(0, "one x", "acgtacg"), (1, "two", "tt"), (2, "three", "acgt" * 60)]
    assert text.template(spark, f"{tmp_path}/r.fasta").first().seq == "".join(x[2] for x in got)
    assert text.record_count(spark, f"{tmp_path}/r.fasta").first().records == 3
    text.write_fasta(text.fasta(spark, f"{tmp_path}/r.fasta"), f"{tmp_path}/w.fasta")
    assert [r.seq for r in text.fasta(spark, f"{tmp_path}/w.fasta").orderBy("read_id").collect()] == [x[2] for x in got]
    (tmp_path / "sig").write_text("ACGT-_ \nac--gt \n")
    assert [tuple(r) for r in text.signatures(spark, f"{tmp_path}/sig").orderBy("sig_id").collect()] == [(0, "acgt-- "), (1, "ac--gt ")]
    (tmp_path / "bad").write_text("ACGT\nAC\n")
    with pytest.raises(Exception, match="width"):
        text.signatures(spark, f"{tmp_path}/bad").collect()
    (tmp_path / "lab").write_text("3\n\n12\n")
    assert [r.copy_id for r in text.labels(spark, f"{tmp_path}/lab").orderBy("sig_id").collect()] == [3, -1, 12]
    (tmp_path / "typed").write_text("Read 6 : No28 Ku29 Ze\nRead 7 :\n")
    assert [tuple(r) for r in text.typed_lists(spark, f"{tmp_path}/typed").orderBy("y").collect()] == [(6, 0, "No", 28), (6, 1, "Ku", 29), (6, 2, "Ze", -1)]
    (tmp_path / "ints").write_text("0 1 2\n\n3\n")
    items = text.numbered_lists(spark, f"{tmp_path}/ints")
    assert rows_of(items) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (2, 0, 3)]
    text.write_lists(items, f"{tmp_path}/lists")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lists").collect()) == ["0 1 2", "3"]


def test_simulation_is_seeded(spark):
    copies = simulate.copies(spark, 200, 4, 10, seed=3)
    a, b = rows_of(simulate.reads(copies, 3, 5)), rows_of(simulate.reads(copies.repartition(3), 3, 5))
    assert a == b and len(a) == 12 and len({s for _, s in rows_of(copies)}) > 1
    assert rows_of(simulate.reads(copies, 1, 5, (0, 0, 0)).select("copy_id", "seq")) == rows_of(copies)
    places = simulate.complex_reads(spark, "acgt" * 200, [(50, 1), (80, 1)], 20, rates=(0, 0, 0)).collect()
    assert all(len(r.seq) <= 80 for r in places) and len({r.start_pos for r in places}) > 10


def test_partitioning_changes_nothing(spark):
    msa = profile.to_long(spark.createDataFrame([(i, "acgt-"[i % 5 :] + "acgt-"[: i % 5]) for i in range(20)], "row_id long, row string"))
    for f in (profile.column_profile, profile.row_scores, profile.base_paths, profile.blank_terminal_gaps):
        assert rows_of(f(msa)) == rows_of(f(msa.repartition(7)))


def test_purity_and_stats_without_groups(spark):
    m, t = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 4)], "layer int, seg_id int"), spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 9)], "seg_id int, copy_id int")
    assert rows_of(evaluate.purity(m, t)) == [(0, 7, 2, 3), (1, 9, 1, 1)]
    none = spark.createDataFrame([], "grp int, row_id long, col int, base string")
    assert evaluate.correction_stats(none, none).first().accuracy is None
    assert np.isclose(evaluate.placed_percent(evaluate.purity(m, t)).first().percent, 75.0)


def test_correction_with_flanks(spark):
    rng = random.Random(9)
    rows = []
    for x in range(60):
        for y in range(3):
            k = (x + y) % 3
            sig = "".join(rng.choice("acgt") if rng.random() < 0.05 else c for c in ("acgtac", "ccgaag", "tctata")[k])
            rows.append((x, y, "No", 3 * x + y, sig))
    items = spark.createDataFrame(rows + [(99, 0, "Li", None, None)], "read_id int, y int, klass string, sig_id long, sig string")
    ext = learn.extended(items, 6, 6, {"Li": "x"})
    assert ext.count() == 180 and ext.where(F.length("sig") != 18).count() == 0
    models = learn.train(ext, 6, range(6), flank=6, rounds=60, stop=101)
    final, first = learn.correct_reads(items, models, 6, 6, {"Li": "x"}, rounds=2)
    truth = {3 * x + y: ("acgtac", "ccgaag", "tctata")[(x + y) % 3] for x in range(60) for y in range(3)}
    wrong = lambda d: sum(a != b for i, s in d.items() for a, b in zip(s, truth[i]))
    assert wrong({r.sig_id: r.sig for r in final.collect()}) < 0.5 * wrong({r[3]: r[4] for r in rows}) and first.count() == 180


def test_modes_and_copy_numbers(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c"), (2, "a")], "g int, v string")
    assert rows_of(evaluate.commonest(rows, ["g"], "v")) == [(1, "a", 1), (2, "c", 2)]
    places = spark.createDataFrame([(0, 100, 4900), (1, 4500, 3000), (2, 4500, 400), (3, 5000, 10)], "read_id int, start_pos long, first_len int")
    assert rows_of(evaluate.copy_numbers(places, 5000)) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_records_begin_at_the_start_of_a_line(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">one a>b\r\nacgt\r\nAC\r\n>two > three\ngg\n")
    got = [tuple(r) for r in text.fasta(spark, f"{tmp_path}/x.fasta").orderBy("read_id").collect()]
    assert got == [(0, "one a>b", "acgtac"), (1, "two > three", "gg")]
    assert text.record_count(spark, f"{tmp_path}/x.fasta").first().records == 2
    (tmp_path / "none.fasta").write_text("")
    assert text.fasta(spark, f"{tmp_path}/none.fasta").count() == 0


def test_more_formats_round_trip(spark, tmp_path):
    kinds = spark.createDataFrame([(0, "r"), (1, "l"), (2, "r")], "seg_id long, klass string")
    text.write_classes(kinds, f"{tmp_path}/k")
    assert rows_of(text.classes(spark, f"{tmp_path}/k")) == rows_of(kinds)
    places = spark.createDataFrame([(0, 5000), (1, 17)], "read_id long, start_pos long")
    text.write_placements(places, f"{tmp_path}/p")
    assert rows_of(text.placements(spark, f"{tmp_path}/p")) == rows_of(places)
    msa = spark.createDataFrame([(0, "ac-t "), (1, " c-t ")], "row_id long, row string")
    text.write_alignment(msa, f"{tmp_path}/a")
    assert rows_of(text.alignment(spark, f"{tmp_path}/a")) == rows_of(msa)
    assert text.records_without_repeats(spark.createDataFrame([(0, "acg"), (1, "ac")], "read_id long, seq string"), spark.createDataFrame([(0, "r"), (1, "l")], "read_id long, klass string")).first() == (1, 2)
    with pytest.raises(Exception, match="acgt"):
        text.valid_alphabet(spark.createDataFrame([("ax",)], "sig string")).collect()


def test_coverage_from_both_ends(spark):
    sig = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "sig_id long, sig string")
    assert cluster.coverage_extent(sig(*[" acgt a"] * 10), 7).first().extent == 1
    assert cluster.coverage_extent(sig(*["  acg  "] * 10), 7).first().extent == 3
    assert cluster.coverage_extent(sig("a"), 1).first().extent is None
    assert cluster.both_edges_covered(sig(" acgt a", "  cgt a"), 1).count() == 1
    items = spark.createDataFrame([(0, "r", "acgta"), (1, "r", "a gta"), (2, "l", " c   "), (3, "l", "g    "), (4, "m", "  t  ")], "sig_id long, klass string, sig string")
    assert [tuple(r) for r in cluster.seed_centroids(items, 1).orderBy("cluster_id").collect()] == [(0, " cgt "), (1, " c   "), (2, "  t  ")]


def test_successions_by_distance_and_cuts(spark):
    hits = spark.createDataFrame([(1, 100, 0), (1, 205, 1), (1, 420, 2), (2, 50, 1)], "read_id long, pos long, part int")
    assert rows_of(reads.order_matrix(hits, 100, 20)) == [(0, 1, 1)]
    assert rows_of(reads.distance_histogram(hits, 100)) == [(0, 1, int(math.log(6) / math.log(1.5)), 1), (1, 2, int(math.log(116) / math.log(1.5)), 1)]
    lengths = spark.createDataFrame([(1, 700), (2, 700)], "read_id long, size int")
    assert rows_of(reads.cut_candidates(hits, lengths, 3, 100)) == [(1, 305), (1, 420), (2, 150)]
    assert rows_of(reads.cut_candidates(hits, lengths, 1, 50)) == [(1, 100)]


def test_shared_neighbours_against_all_pairs(spark):
    rng = random.Random(8)
    links = {(i, rng.choice([0, 0, 0, *range(12)])) for i in range(60) for _ in range(5)}
    near = {}
    for i, j in links:
        near.setdefault(i, set()).add(j)
    for least in (1, 2, 3):
        want = sorted((i, k, len(near[i] & near[k])) for i in near for k in near if i < k and len(near[i] & near[k]) >= least)
        assert rows_of(cluster.shared_neighbours(spark.createDataFrame(sorted(links), "i long, j long"), least)) == want


def test_variants_of_either_sign_and_all_seeds(spark):
    base = "acgtgtcatgacgtacctga" * 3
    cut = base[:20] + "-" * 12 + base[32:]
    rows = [(i, cut) for i in range(12)] + [(20 + i, base) for i in range(8)]
    got = rows_of(indel.detect(spark.createDataFrame(rows, "sig_id long, sig string"), 0, 60, 40, 20, 0, 5))
    assert got == [(w, 20 + i) for w in (0, 20) for i in range(8)]
    noisy = [(i, "".join("acgt"[(i // 4**k) % 4] for k in range(4)) + "a" * 20) for i in range(200)]
    members, _ = cluster.window_clusters(spark.createDataFrame(noisy, "sig_id long, sig string"), 24, 300, 1)
    assert members.where("diff > 0").count() == 0  # every distinct row was a seed


def test_layers_of_any_ids(spark):
    items = spark.createDataFrame([(x, y, c) for x in range(6) for y, c in enumerate([70, 9, 5000, 12])], "x int, y int, cluster_id int")
    edge = graph.edges(items)
    assert graph.layers_of(edge, [70]) == {70: 0, 9: 1, 5000: 2, 12: 3}
    assert graph.layers_of(edge, [9], start_layer=1) == {9: 1, 70: 0, 5000: 2, 12: 3}
    assert graph.layers_of(edge, [5000]) == {5000: 0, 12: 1}  # nothing goes below layer 0
    with pytest.raises(ValueError):
        graph.layering(edge, 9, 10)


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    from plait.plans import staging

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Cluster)


def test_realignment_within_a_band():
    rng = random.Random(3)
    base = "".join(rng.choice("acgt") for _ in range(60))
    rows = ["".join(c if rng.random() > 0.15 else rng.choice(["", "a", "-", c + "g"]) for c in base) for _ in range(12)]
    rows = [r.ljust(max(map(len, rows))) for r in rows]
    def score(out):
        return sum(sum(n * (sum(c.values()) - n) for n in c.values()) for c in (Counter(x for x in col if x != " ") for col in zip(*out)))
    scores = [score(rows)]
    for band in (1, 5, 1000):
        out = align._realigned(rows, band, 100)
        assert [r.replace("-", "").strip() for r in out] == [r.replace("-", "").strip() for r in rows]
        scores.append(score(out))
    assert scores[0] > scores[1] and scores[0] > scores[3] and min(scores[1:]) < 0.6 * scores[0]


def test_predictions_of_blocks_are_those_of_single_networks(spark, monkeypatch):
    rng = random.Random(2)
    sigs = spark.createDataFrame([(i, "".join(rng.choice("acgt- ") for _ in range(9))) for i in range(80)], "sig_id long, sig string")
    models = learn.train(sigs, 9, range(9), rounds=2, stop=101).cache()
    nets = {r.v: (np.array(r.w0).reshape(-1, len(r.b0)), np.array(r.b0), np.array(r.w1).reshape(len(r.b0), 5), np.array(r.b1)) for r in models.collect()}
    monkeypatch.setattr(learn, "NET_BLOCK", 4)
    got = {r.sig_id: r.sig for r in learn.predict(sigs, models, 9, mask=False).collect()}
    for r in sigs.collect():
        hot = learn.one_hot([r.sig], 9)
        want = "".join("acgt-"[int(learn.forward(np.delete(hot, slice(5 * v, 5 * v + 5), axis=1), nets[v], "tanh")[1].argmax())] for v in range(9))
        assert got[r.sig_id] == want


def _indel_brute(rows, first, last, width, step, members):
    """By loops: consensuses of each cluster in a window, larger clusters split by their distinct rows first."""
    far = lambda a, b: sum(x != y and x != " " and y != " " for x, y in zip(a, b))

    def agreed(texts):
        out = ""
        for column in zip(*texts):
            n = [column.count(b) for b in "acgt-"]
            out += "acgt-"[n.index(max(n))] if max(n) else " "
        return out

    def split(texts, most):
        seeds = sorted(set(texts), key=lambda t: (-texts.count(t), t))
        for turn in range(2):
            groups = {}
            for t in texts:
                groups.setdefault(min(range(len(seeds)), key=lambda k: (far(t, seeds[k]), k)), []).append(t)
            if turn:
                return list(groups.values())
            best = sorted((k for k in groups if len(groups[k]) >= 6), key=lambda k: (-len(groups[k]), k))[:most]
            # centroids keep their numbers
            seeds = [agreed(groups[k]) for k in sorted(best)]
            if not seeds:
                return []

    out = set()
    for at in range(first, max(first, last - width) + 1, step):
        part = {i: s[at : at + width] for i, s in rows if s[at : at + width].strip()}
        found = []
        for ids in members.values():
            texts = [part[i] for i in ids if i in part]
            if len(ids) >= 6:
                found += [(agreed(g), len(g)) for g in (split(texts, len(ids) // 15) if len(ids) > 30 else [texts]) if len(g) >= 8]
        full = sorted({k for k, _ in found if " " not in k}, key=lambda k: (sum(t == k for t, _ in found), sum(n for t, n in found if t == k), k))
        for kon in full[:-1]:
            if far(kon, full[-1]) > width / 200:
                out |= {(at, i) for i, s in part.items() if far(s, full[-1]) > far(s, kon) + 1}
    return sorted(out)


def test_indels_within_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("acgt") for _ in range(60))
    kinds = [base, base[:22] + "-" * 9 + base[31:], base[:40] + "ttttt" + base[45:]]
    rows, members = [], {}
    for i in range(150):
        text = "".join(c if rng.random() > 0.04 else rng.choice("acgt-") for c in kinds[rng.choice([0, 0, 0, 1, 2])])
        rows.append((i, " " * rng.choice([0, 0, 0, 25]) + text[25:] if rng.random() < 0.1 else text))
        members.setdefault(min(i // 60, 3) if i < 140 else 4 + i % 3, []).append(i)
    rows = [(i, s.rjust(60)[:60]) for i, s in rows]
    table = spark.createDataFrame(rows, "sig_id long, sig string")
    held = spark.createDataFrame([(c, i) for c, ids in members.items() for i in ids], "cluster_id long, sig_id long")
    want = _indel_brute(rows, 0, 60, 20, 10, members)
    assert want and rows_of(indel.detect(table, 0, 60, 20, 10, members=held)) == want
    assert rows_of(indel.detect(table.limit(0), 0, 60, 20, 10, members=held)) == []


def test_reads_joined_and_padded(spark):
    items = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (3, 1, "e"), (3, 2, "f")], "read_id long, y long, klass string")
    joins = spark.createDataFrame([(1, 3, 1), (1, 2, 0), (2, 9, 0), (3, 2, 5)], "read_id long, other_id long, skip int")
    got = rows_of(reads.concatenate(items, joins))
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "e"), (1, 4, "f"), (2, 0, "c"), (3, 0, "d"), (3, 1, "e"), (3, 2, "f")]
    assert rows_of(reads.concatenate(items, joins.limit(0))) == rows_of(items)
    pads = spark.createDataFrame([(2, 2, 0, "L"), (1, 0, 1, "R")], "read_id long, before int, after int, klass string")
    padded = rows_of(reads.pad_reads(items, pads))
    assert padded == [(1, 0, "a"), (1, 1, "b"), (1, 2, "R"), (2, 0, "L"), (2, 1, "L"), (2, 2, "c"), (3, 0, "d"), (3, 1, "e"), (3, 2, "f")]


def test_softmax_nets_stop_and_slow_down():
    rng = np.random.default_rng(3)
    x = (rng.random((300, 20)) < 0.5).astype(float)
    y = np.zeros((300, 5))
    y[np.arange(300), (x[:, 0] > 0).astype(int)] = 1
    args = ("softmax", 10, 60, 50, 0.02, 0.5, 1)
    net, right = learn.train_net(x, y, *args)
    told = learn.forward(x, net, "softmax")[1].argmax(axis=1)
    assert right > 96 and len(set(told)) == 2
    y[:] = [1, 0, 0, 0, 0]  # one answer is right for all rows
    _, right = learn.train_net(x, y, *args)
    assert right == 100


def test_assess_counts_answers(spark):
    sigs = spark.createDataFrame([(i, "acgt" if i % 2 else "tgca") for i in range(40)] + [(40, "ac  ")], "sig_id long, sig string")
    models = learn.train(sigs, 4, range(4), rounds=40)
    got = learn.assess(sigs, models, 4).collect()
    assert sum(r.n for r in got) == 162 and sum(r.n for r in got if r.truth == r.predicted) > 150


def test_realigned_rows_are_as_good_as_one_task(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("acgt") for _ in range(50))
    noisy = ["".join((rng.choice("acgt") if rng.random() < 0.04 else c) + (rng.choice("acgt") if rng.random() < 0.08 else "") for c in base if rng.random() > 0.08) for _ in range(60)]
    traced = align.traces(spark.createDataFrame([(i, s, s, base) for i, s in enumerate(noisy)], "row_id long, kept string, seq string, template string"))
    cells = profile.blank_terminal_gaps(align.star_alignment(traced.select("row_id", "trace", F.col("kept").alias("seq"))))
    rows = rows_of(profile.to_wide(cells, cells.agg(F.max("col")).first()[0] + 1))
    table = spark.createDataFrame([*rows, (100, None), (101, "  ")], "row_id long, row string")
    score = lambda texts: align._pairs_score(align._column_counts(spark.createDataFrame([(t,) for t in texts], "row string"))[0])
    got = rows_of(align.realign_rows(table, 1000, 20))
    assert [r.replace("-", "").strip() for _, r in got] == [*[r.replace("-", "").strip() for _, r in rows], "", ""] and len({len(r) for _, r in got}) == 1
    width = max(len(r) for _, r in rows)
    one = align._realigned([r.ljust(width) for _, r in rows], 1000, 20)
    assert score([r for _, r in got]) < score([r for _, r in rows]) and score([r for _, r in got]) < 1.01 * score(one)
    assert rows_of(align.realign_rows(table.limit(0))) == []
