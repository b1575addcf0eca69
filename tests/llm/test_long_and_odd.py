"""Every operator and the pipeline on one very long text beside nulls, empty texts, repeated rows and clashing names; and on empty tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import common, huffman_ids, language_id, license_rules, media_tiles, near_copies, quality_rules, rff_quality, sentencepiece_chunks, simhash_vp, ss_packing, url_filter

WORDS = [f"word{i}" if i % 3 else f"the{i}" for i in range(5000)]
LONG = " ".join(WORDS[k] + ("." if i % 11 == 0 else "") for i, k in enumerate(np.random.default_rng(0).integers(0, 5000, 1_100_000).tolist()))  # some 9 MB
NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, open string, kept string, score string, ids string, bucket string, `a.b` string"


@pytest.fixture(scope="module")
def docs(spark):
    own = [(1, LONG), (2, None), (3, ""), (4, "only a few words here"), (4, "only a few words here"), (None, "only a few words here"), (5, "12 34"), (None, None)]
    return spark.createDataFrame([(i, x, "en" if i != 4 else None, "s", 0, 7, "o", "k", "s", "i", "b", "c") for i, x in own], NAMES).repartition(2)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def of_long(df):
    r = df.where("doc_id = 1").collect()
    assert len(r) == 1
    return r[0]


def test_each_operator(spark, docs):
    raw, n = LONG.encode(), docs.count()
    out = quality_rules.judge(docs)
    assert out.count() == n and of_long(out)["n_words"] == 1_100_000
    assert quality_rules.keep(docs).columns == docs.columns
    out = simhash_vp.near_duplicates(docs)
    assert out.count() == n and len(of_long(out)["fingerprint"]) == 16
    out = sentencepiece_chunks.encode_and_decode(docs).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.size("ids").alias("n"))
    assert out.count() == n and of_long(out)["sha"] == hashlib.sha256(raw).hexdigest()
    files = huffman_ids.read(spark, huffman_ids.write(docs)).select("doc_id", "n_tokens", F.octet_length("tokens").alias("size"))
    assert files.count() == n and of_long(files)["size"] == 4 * of_long(files)["n_tokens"]
    assert rff_quality.classify(docs, spark.createDataFrame([(1, 1), (4, 0)], "doc_id bigint, quality int")).count() == n
    assert license_rules.scan(docs).count() == n
    model = language_id.train(docs)
    assert of_long(language_id.predict(docs, model))["lang_pred"] == "en" and language_id.keep(docs, model).columns == docs.columns
    out = media_tiles.features(common.written(media_tiles.store(media_tiles.text_images(docs)), "m")).select("doc_id", "n_bytes", F.crc32(F.substring("payload", 1, len(raw))).alias("crc"))
    assert out.count() == n and of_long(out)["crc"] == zlib.crc32(raw)
    packed = ss_packing.pack(ss_packing.pieces(docs).drop("tokens"))
    lengths = [r["length"] for r in packed.where("doc_id = 1").orderBy("piece").collect()]
    assert set(lengths[:-1]) == {4096} and len(lengths) > 200
    assert sorted(r["doc_id"] or 0 for r in near_copies.keep_one(docs).collect()) == [1, 2, 4, 5]  # nulls and empty texts are one group
    assert url_filter.judge(docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.net/de/"), "text").alias("url"))).count() == n


def test_each_operator_on_an_empty_table(spark, none):
    for out in (
        quality_rules.judge(none), quality_rules.keep(none), simhash_vp.near_duplicates(none), sentencepiece_chunks.encode_and_decode(none), huffman_ids.read(spark, huffman_ids.write(none)), license_rules.scan(none), language_id.keep(none, language_id.train(none)),
        media_tiles.features(media_tiles.store(media_tiles.text_images(none))), ss_packing.pack(ss_packing.pieces(none).drop("tokens")), near_copies.keep_one(none),
    ):
        assert out.count() == 0


def chain(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, ""), name)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    return docs


def test_the_pipeline(spark, docs, none):
    prose = [" ".join(np.random.default_rng(i).choice(WORDS, 80)) for i in range(3)]
    more = [(10, prose[0]), (11, prose[0]), (11, prose[0]), (12, prose[1] + " end"), (None, prose[1]), (None, prose[2])]
    all_docs = docs.unionByName(spark.createDataFrame([(i, x, "en", "s", 0, 7, "o", "k", "s", "i", "b", "c") for i, x in more], NAMES))
    out = chain(spark, all_docs).collect()
    assert {r["doc_id"] for r in out} == {1, 10, 12, None} and sum(r["doc_id"] is None for r in out) == 1
    assert max(sum(x["length"] for x in out if x["sequence_id"] == s) for s in {r["sequence_id"] for r in out}) <= 4096
    assert chain(spark, none).count() == 0
    # Stages are given what the one before wrote, and a table without any row to learn from.
    assert chain(spark, all_docs.withColumn("lang", F.lit(None).cast("string"))).select("doc_id").distinct().count() == 4
