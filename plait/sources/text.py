"""Readers and writers of the line and record formats.  Ids follow the place in the files."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plait.functions.bases import ALPHABET, normalise, normalise_cells
from plait.operators.reads import global_number
from plait.plans.staging import stage


def lines(spark: SparkSession, path: str, name: str = "line_id") -> DataFrame:
    """(line_id, value): lines numbered from 0 in file order, blank ones too."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return global_number(raw, ["f", "b", "i"], name).select(name, "value")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``value``, one for each record: a ``>`` counts at the start of a line only."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    return raw.select(F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\A>", "").alias("value"), "_metadata").where("trim(value, ' \n\t') != ''")


def fasta(spark: SparkSession, path: str, name: str = "read_id") -> DataFrame:
    """(read_id, header, seq): records of any number of lines; lower case, what is no base dropped; the last one too."""
    at = _records(spark, path).select(F.split("value", "\n", 2).alias("p"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    body = F.coalesce(F.get("p", F.lit(1)), F.lit(""))
    return global_number(at, ["f", "b", "i"], name).select(name, F.trim(F.col("p")[0]).alias("header"), normalise(body).alias("seq"))


def template(spark: SparkSession, path: str) -> DataFrame:
    """One row: seq, all records one after the other."""
    return fasta(spark, path).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("read_id", "seq"))), lambda x: x["seq"]), "").alias("seq"))  # a template is one sequence


def record_count(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path).agg(F.count("*").alias("records"))


def records_without_repeats(reads: DataFrame, classes: DataFrame) -> DataFrame:
    """One row: records, and the greatest length, of sequences whose class is not ``r``."""
    return reads.join(classes, "read_id").where("klass != 'r'").agg(F.count("*").alias("records"), F.max(F.length("seq")).alias("longest"))


def alignment(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, row) over ``acgt-`` and blank; rows of other widths stop the read."""
    rows = lines(spark, path, "row_id").where("value != ''").select("row_id", normalise_cells(F.col("value")).alias("row"))
    return same_width(rows, "row")


def same_width(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` as they are; a row whose width is not the widest's raises an error when it is read."""
    width = rows.agg(F.max(F.length(column)).alias("__w"))
    checked = rows.crossJoin(F.broadcast(width))  # one row
    ok = F.assert_true(F.length(column) == F.col("__w"), F.lit("rows differ in width"))
    return checked.withColumn(column, F.when(ok.isNull(), F.col(column))).drop("__w")


def valid_alphabet(sigs: DataFrame, column: str = "sig") -> DataFrame:
    """``sigs`` as they are; other characters than ``acgt-`` and blank raise an error when they are read."""
    ok = F.assert_true(F.translate(column, ALPHABET, "") == "", F.lit("not over acgt- and blank"))
    return sigs.withColumn(column, F.when(ok.isNull(), F.col(column)))


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """(sig_id, sig), lower case, ``_`` a gap; width and alphabet are checked."""
    rows = lines(spark, path, "sig_id").where("value != ''").select("sig_id", F.translate(F.lower("value"), "_", "-").alias("sig"))
    return valid_alphabet(same_width(rows, "sig"))


@dataclass
class Checked:
    """Rows that can be used, those that cannot with their reasons, and how many there are of each reason."""

    rows: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def _sorted_out(rows: DataFrame, name: str, reason: Column) -> Checked:
    """``rows`` written once with what is wrong with them, null for nothing; the counts are those of that very write."""
    kinds = ["width", "alphabet", "errors"]
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    flagged = rows.withColumn("reason", reason)
    counted = flagged.observe(seen, F.count("*").alias("all"), *[F.count_if(F.col("reason") == k).alias(k) for k in kinds])
    held = stage(counted, name)
    found = {k: v for k, v in seen.get.items() if k == "all" or v}
    return Checked(held.where("reason is null").drop("reason"), held.where("reason is not null"), found)


def checked_signatures(spark: SparkSession, path: str, width: int | None = None) -> Checked:
    """As ``signatures``, but rows that are wrong go to a table of their own instead of stopping the read.

    A row is rejected for ``width`` where its length is not ``width`` (by default that of most rows, of several the
    greatest), else for ``alphabet`` where it has other characters than ``acgt-`` and blank.  Ids follow the file,
    rejected rows included; blank lines have none; an empty file gives no rows and counts 0.
    """
    rows = lines(spark, path, "sig_id").where("value != ''").select("sig_id", F.translate(F.lower("value"), "_", "-").alias("sig"))
    if width is None:
        most = rows.groupBy(F.length("sig").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
        width = most.w if most else 0
    wrong = F.when(F.length("sig") != width, "width").when(F.translate("sig", ALPHABET, "") != "", "alphabet")
    return _sorted_out(rows, "signatures", wrong)


def checked_placements(placed: DataFrame, cutoff: float = 0.30) -> Checked:
    """``placed(…, dist, len)`` sorted by mapping errors: rows with ``cutoff`` errors per base or more are rejected for ``errors``.

    Rows whose distance or length is null, or of no length, are rejected, too.
    """
    fits = F.coalesce((F.col("len") > 0) & (F.col("dist") < cutoff * F.col("len")), F.lit(False))
    return _sorted_out(placed, "placements", F.when(~fits, "errors"))


def classes(spark: SparkSession, path: str) -> DataFrame:
    """(seg_id, klass)."""
    return lines(spark, path, "seg_id").select("seg_id", F.trim("value").alias("klass")).where("klass != ''")


def numbered_lists(spark: SparkSession, path: str, name: str = "read_id", item: str = "seg_id") -> DataFrame:
    """(read_id, pos, seg_id) of lines of whole numbers set apart by blanks."""
    rows = lines(spark, path, name)
    return rows.select(name, F.posexplode(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")).alias("pos", item)).withColumn(item, F.col(item).cast("long"))


def typed_lists(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, y, klass, sig_id) of lines like ``Read 6 : No28 Ku29``; the class is two letters, no number is -1."""
    rows = lines(spark, path, "line_id").select(F.regexp_extract("value", r"^\s*Read\s+(\d+)", 1).alias("n"), F.regexp_extract("value", r":(.*)$", 1).alias("items")).where("n != ''")
    items = F.filter(F.split(F.trim("items"), r"\s+"), lambda x: x != "")
    return rows.select(F.col("n").cast("long").alias("read_id"), F.posexplode(items).alias("y", "item")).select("read_id", "y", F.substring("item", 1, 2).alias("klass"), F.coalesce(F.substring("item", 3, 20).try_cast("int"), F.lit(-1)).alias("sig_id"))


def labels(spark: SparkSession, path: str, unknown: int = -1) -> DataFrame:
    """(sig_id, copy_id); a blank line is ``unknown``."""
    return lines(spark, path, "sig_id").select("sig_id", F.coalesce(F.trim("value").try_cast("int"), F.lit(unknown)).alias("copy_id"))


def placements(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, start_pos)."""
    return lines(spark, path, "read_id").select("read_id", F.trim("value").try_cast("long").alias("start_pos")).where("start_pos is not null")


def placement_histogram(places: DataFrame, width: int = 5000, column: str = "start_pos") -> DataFrame:
    """(bucket, n)."""
    return places.groupBy(F.floor(F.col(column) / width).alias("bucket")).agg(F.count("*").alias("n"))


def write_rows(rows: DataFrame, key: str, value, path: str) -> None:
    """One line per row in order of ``key``: a range sort, so that part files follow one another."""
    rows.select(key, value.alias("value")).sort(key).select("value").write.text(path)


def write_alignment(rows: DataFrame, path: str, upper: bool = True) -> None:
    write_rows(rows, "row_id", F.upper("row") if upper else F.col("row"), path)


def write_classes(classes_df: DataFrame, path: str) -> None:
    """A class per line in order of ``seg_id``, as ``classes`` reads them."""
    write_rows(classes_df, "seg_id", F.col("klass"), path)


def write_placements(places: DataFrame, path: str) -> None:
    """A start per line in order of ``read_id``, as ``placements`` reads them."""
    write_rows(places, "read_id", F.col("start_pos").cast("string"), path)


def write_signatures(sigs: DataFrame, path: str) -> None:
    write_rows(sigs, "sig_id", F.lower("sig"), path)


def write_fasta(reads: DataFrame, path: str, key: str = "read_id", width: int = 100) -> None:
    """Records with lines of ``width`` bases."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    write_rows(reads, key, F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), body), path)


def write_lists(items: DataFrame, path: str, key: str = "read_id", order: str = "pos", item: str = "seg_id") -> None:
    """A line of items for each key, as in ``numbered_lists``."""
    listed = items.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item].cast("string")).alias("l"))
    write_rows(listed, key, F.array_join("l", " "), path)


def write_clusters(members: DataFrame, path: str) -> None:
    """A line of members, ascending, for each cluster of several of ``members(cluster_id, i)``, as ``numbered_lists`` reads them."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").select("cluster_id")
    write_lists(members.select("cluster_id", "i", F.col("i").alias("place")).join(sizes, "cluster_id", "left_semi"), path, "cluster_id", "place", "i")
