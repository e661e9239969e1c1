"""Queries that write a table in one of the line or record formats, read the files back and return what was read.

They stand in the registry of ``plait.queries``.  Files lie in the shared folder and go when the driver's Python ends.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plait.functions import bases as B
from plait.operators import align
from plait.plans.staging import folder
from plait.queries import _CELLS, _LAST_ROWS, items, query, sigs, table
from plait.sources import text

_LETTERS, _TO = "bdefhijklmnopqrsuvwxyz", "acgtacgtacgtacgtacgtac"
_PART_SQL = f"seqs AS (SELECT p_partkey AS k, regexp_replace(translate(lower(p_name), '{_LETTERS}', '{_TO}'), '[^acgt]', '', 'g') AS seq FROM part)"


def _seq(name):
    return B.normalise(F.translate(F.lower(name), _LETTERS, _TO))


def _parts_file(spark, sf) -> str:
    path = folder(spark, "fasta")
    text.write_fasta(table(spark, sf, "part").select(F.col("p_partkey").alias("read_id"), _seq(F.col("p_name")).alias("seq")), path, width=7)
    return path


@query("fasta_records", f"WITH {_PART_SQL} SELECT row_number() OVER (ORDER BY k) - 1 AS read_id, k::VARCHAR AS header, seq FROM seqs")
def fasta_records(spark, sf):
    return text.fasta(spark, _parts_file(spark, sf))


@query("fasta_record_count", "SELECT count(*) AS records FROM part")
def fasta_record_count(spark, sf):
    return text.record_count(spark, _parts_file(spark, sf))


@query("fasta_template", f"SELECT string_agg(regexp_replace(translate(lower(n_name), '{_LETTERS}', '{_TO}'), '[^acgt]', '', 'g'), '' ORDER BY n_nationkey) AS seq FROM nation")
def fasta_template(spark, sf):
    path = folder(spark, "template")
    text.write_fasta(table(spark, sf, "nation").select(F.col("n_nationkey").alias("read_id"), _seq(F.col("n_name")).alias("seq")), path)
    return text.template(spark, path)


@query("records_without_repeats", f"""WITH {_PART_SQL}, c AS (SELECT p_partkey AS k, p_type FROM part)
SELECT count(*) AS records, max(length(seq))::INTEGER AS longest FROM seqs JOIN c USING (k) WHERE p_type <> 'ECONOMY'""")
def records_without_repeats(spark, sf):
    path = folder(spark, "classes")
    kinds = F.when(F.col("p_type") == "ECONOMY", "r").otherwise("l").alias("klass")
    text.write_classes(table(spark, sf, "part").select(F.col("p_partkey").alias("seg_id"), kinds), path)
    return text.records_without_repeats(text.fasta(spark, _parts_file(spark, sf)), text.classes(spark, path).withColumnRenamed("seg_id", "read_id"))


@query("alignment_file", f"WITH {_CELLS} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, sig AS \"row\" FROM sigs")
def alignment_file(spark, sf):
    path = folder(spark, "alignment")
    text.write_alignment(sigs(spark, sf).select(F.col("sig_id").alias("row_id"), F.col("sig").alias("row")), path)
    return text.alignment(spark, path)


@query("signature_file", f"WITH {_CELLS} SELECT row_number() OVER (ORDER BY row_id) - 1 AS sig_id, sig FROM sigs")
def signature_file(spark, sf):
    path = folder(spark, "signatures")
    text.write_signatures(sigs(spark, sf).select("sig_id", "sig"), path)
    return text.signatures(spark, path)


#: Every seventh row loses its end, every fifth gets a letter that is no base.
_SPOILT = "CASE WHEN row_id % 7 = 3 THEN sig[1:40] WHEN row_id % 5 = 1 THEN 'x' || sig[2:] ELSE sig END"
_CHECKED = f"""{_CELLS}, l AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS sig_id, {_SPOILT} AS sig FROM sigs),
m AS (SELECT length(sig) AS w FROM l GROUP BY w ORDER BY count(*) DESC, w DESC LIMIT 1),
r AS (SELECT sig_id, sig, CASE WHEN length(sig) <> w THEN 'width' WHEN translate(sig, 'acgt- ', '') <> '' THEN 'alphabet' END AS reason FROM l, m)"""


def _checked(spark, sf):
    path = folder(spark, "spoilt")
    spoilt = F.when(F.col("sig_id") % 7 == 3, F.left("sig", F.lit(40))).when(F.col("sig_id") % 5 == 1, F.concat(F.lit("x"), F.expr("substring(sig, 2)"))).otherwise(F.col("sig"))
    text.write_signatures(sigs(spark, sf).select("sig_id", spoilt.alias("sig")), path)
    return text.checked_signatures(spark, path)


@query("rejected_signatures", f"WITH {_CHECKED} SELECT sig_id, sig, reason FROM r WHERE reason IS NOT NULL")
def rejected_signatures(spark, sf):
    return _checked(spark, sf).rejected


@query("accepted_signatures", f"WITH {_CHECKED} SELECT sig_id, sig FROM r WHERE reason IS NULL")
def accepted_signatures(spark, sf):
    return _checked(spark, sf).rows


@query("rejection_counts", f"WITH {_CHECKED} SELECT coalesce(reason, 'all') AS reason, count(*) AS n FROM (SELECT reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT NULL FROM r) GROUP BY reason")
def rejection_counts(spark, sf):
    return spark.createDataFrame(sorted(_checked(spark, sf).counts.items()), "reason string, n long")


@query("mapping_filter", """WITH RECURSIVE pairs AS (SELECT DISTINCT lower(p_type) AS a, p_name AS b FROM part),
""" + _LAST_ROWS + """ SELECT p_partkey, list_min(r) AS dist, length(p_type) AS len FROM part JOIN dp ON lower(p_type) = a AND p_name = b AND i = length(a) WHERE list_min(r) < 0.75::DOUBLE * length(p_type)""")
def mapping_filter(spark, sf):
    placed = align.place(table(spark, sf, "part").select("p_partkey", F.length("p_type").alias("len"), F.lower("p_type").alias("p_type"), "p_name"), "p_type", "p_name")
    return text.checked_placements(placed.select("p_partkey", "dist", "len"), 0.75).rows


@query("cluster_file", """WITH c AS (SELECT c_nationkey, list(c_custkey ORDER BY c_custkey) AS m FROM customer GROUP BY c_nationkey HAVING count(*) > 1),
n AS (SELECT row_number() OVER (ORDER BY c_nationkey) - 1 AS cluster_id, m FROM c) SELECT cluster_id, (unnest(range(len(m))))::INTEGER AS pos, unnest(m)::BIGINT AS i FROM n""")
def cluster_file(spark, sf):
    path = folder(spark, "clusters")
    text.write_clusters(table(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster_id"), F.col("c_custkey").alias("i")), path)
    return text.numbered_lists(spark, path).select(F.col("read_id").alias("cluster_id"), "pos", F.col("seg_id").alias("i"))


@query("class_file", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS seg_id, c_mktsegment AS klass FROM customer")
def class_file(spark, sf):
    path = folder(spark, "classes")
    text.write_classes(table(spark, sf, "customer").select(F.col("c_custkey").alias("seg_id"), F.col("c_mktsegment").alias("klass")), path)
    return text.classes(spark, path)


@query("numbered_lists_file", """WITH r AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS read_id FROM (SELECT DISTINCT l_orderkey FROM lineitem))
SELECT read_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS pos, l_partkey::BIGINT AS seg_id FROM lineitem JOIN r USING (l_orderkey)""")
def numbered_lists_file(spark, sf):
    path = folder(spark, "lists")
    text.write_lists(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("seg_id")), path)
    return text.numbered_lists(spark, path)


@query("typed_lists_file", """SELECT user_id::BIGINT AS read_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS y,
 event_type[1:2] AS klass, CASE WHEN event_type = 'error' THEN -1 ELSE event_id END::INTEGER AS sig_id FROM events""")
def typed_lists_file(spark, sf):
    path = folder(spark, "typed")
    number = F.when(F.col("klass") == "error", "").otherwise(F.col("event_id").cast("string"))
    listed = items(spark, sf).select("read_id", "y", F.concat(F.left("klass", F.lit(2)), number).alias("item")).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("y", "item"))).alias("l"))
    line = F.concat(F.lit("Read "), F.col("read_id").cast("string"), F.lit(" : "), F.array_join(F.transform("l", lambda x: x["item"]), " "))
    text.write_rows(listed.select("read_id", line.alias("line")), "read_id", F.col("line"), path)
    return text.typed_lists(spark, path)


@query("label_file", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS sig_id, CASE WHEN c_acctbal < 0 THEN -1 ELSE c_nationkey END::INTEGER AS copy_id FROM customer")
def label_file(spark, sf):
    path = folder(spark, "labels")
    text.write_rows(table(spark, sf, "customer"), "c_custkey", F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_nationkey").cast("string")), path)
    return text.labels(spark, path)


@query("placement_file", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS read_id, floor(o_totalprice)::BIGINT AS start_pos FROM orders")
def placement_file(spark, sf):
    path = folder(spark, "placements")
    text.write_placements(table(spark, sf, "orders").select(F.col("o_orderkey").alias("read_id"), F.floor("o_totalprice").alias("start_pos")), path)
    return text.placements(spark, path)
