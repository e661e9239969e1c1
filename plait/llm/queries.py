"""The queries of this subpackage: thin callers of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait.llm import audio, collocations, decontam, heaplloyd, langid, linededup, mixing, onebit, quality, secrets, simhash, tokens, urls
from plait.llm.sql import SQL as SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_audio_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # there is no audio table: the bytes of a text stand for 8-bit samples
    return audio.align(_table(spark, sf_dir, "documents"), "doc_id", F.col("text").cast("binary"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model).drop("text")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write(_table(spark, sf_dir, "documents"), tokens.vocabulary_path())
    return tokens.read(manifest, tokens.crc32_of, "ids_crc32", "long")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heaplloyd.compress(_table(spark, sf_dir, "embeddings")).drop("label")


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return onebit.search(rows, onebit.every(rows, 20))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_audio_prints": op1_audio_prints,
    "op2_quality": op2_quality,
    "op3_language_id": op3_language_id,
    "op4_token_ids": op4_token_ids,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scan": op8_secret_scan,
    "op9_url_filter": op9_url_filter,
    "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_vector_codes": op12_vector_codes,
    "op13_nearest": op13_nearest,
}
