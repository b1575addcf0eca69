"""The queries opN_<name>: each operator over its whole table, and the digests of what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, huffman_ids, language_id, license_rules, media_tiles, quality_rules, rff_quality, sentencepiece_chunks, setsketch, simhash_vp, ss_packing, turn_repair, url_filter
from .common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(folds: int, fold: int):
    """Whether crc32 of doc_id as text leaves this remainder; a null doc_id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op3_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_chunks.encode_and_decode(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = huffman_ids.write(_table(spark, sf_dir, "documents"))
    return huffman_ids.read(spark, files).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op6_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(~_held_out(3, 1)).select("doc_id", "quality")
    out = rff_quality.classify(_table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_rules.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.col("first_at").cast("bigint").alias("first_at"), F.array_join("licenses", ",").alias("licenses"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~_held_out(5, 0)), usual=False)
    return language_id.predict(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op9_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(media_tiles.store(media_tiles.text_images(_table(spark, sf_dir, "documents"))), "media")
    out = media_tiles.features(stored)
    payload = F.col("payload")
    return out.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = ss_packing.pieces(_table(spark, sf_dir, "documents"))
    return ss_packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32")))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.summary(turn_repair.repair(turn_repair.damage(_table(spark, sf_dir, "conversations"))))


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.labelled(filter_audit.masks(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_url_filter, op3_simhash_vp, op4_sentencepiece, op5_token_files, op6_rff_quality, op7_license_scan, op8_language_id, op9_media_tiles, op10_packing, op11_turn_repair, op12_setsketch, op13_filter_audit)}
SQL = {"op1_quality_rules": quality_rules.SQL, "op7_license_scan": license_rules.SQL, "op13_filter_audit": filter_audit.SQL}
