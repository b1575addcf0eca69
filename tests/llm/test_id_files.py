"""Files of ids: ids of any type, frequent ids in many buckets, and the whole order by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordloom.llm import chunk_table, huffman_ids

ENCODE = Tokenizer.from_file(chunk_table.tokenizer_path("byte_bpe_50k.json")).encode


def check(spark, docs):
    files = huffman_ids.write(docs)
    got = sorted(huffman_ids.read(spark, files).collect(), key=lambda r: r["start"])
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(rows, key=lambda r: ((r["doc_id"] is not None, r["doc_id"]) if r["doc_id"] is not None else (False,), r["h"], r["text"] or ""))
    start = 0
    assert len(got) == len(order)
    for r, own in zip(got, order, strict=True):
        ids = [*ENCODE(own["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["tokens"])) == (own["doc_id"], start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    return spark.read.parquet(files.segments)


@pytest.mark.parametrize("kind", ["string", "bigint", "date"])
def test_ids_of_any_type(spark, kind):
    docs = spark.range(60).select(F.when(F.col("id") % 9 != 4, F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")) if kind == "date" else F.col("id") * 7 - 100).cast(kind).alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"), F.lit(1).alias("hash"), F.lit(2).alias("bucket"))
    check(spark, docs)


def test_a_frequent_id_has_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(huffman_ids, "SEGMENT", 20)
    docs = spark.range(400).repartition(6).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 2, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 150).alias("text"))
    segments = check(spark, docs)
    of = segments.select("bucket", F.explode("doc_ids").alias("d")).groupBy("d").agg(F.count_distinct("bucket").alias("n")).where("d = 7 or d is null").collect()
    assert len(of) == 2 and all(r["n"] > 1 for r in of)


def test_a_very_long_text(spark):
    check(spark, spark.createDataFrame([(1, "some words and more " * 200_000), (0, None), (2, "x" * 100_000)], "doc_id bigint, text string"))
