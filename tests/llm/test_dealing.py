"""Packing of pieces that share one id, and components whose rounds run out."""

import pytest
from pyspark.sql import functions as F

from recordloom.llm import components, ss_packing


@pytest.mark.parametrize("own", ["7L", "CAST(NULL AS BIGINT)"])
def test_pieces_of_one_id_are_dealt_to_many_groups(spark, monkeypatch, own):
    seen = spark.sparkContext.accumulator(0)
    inner = ss_packing.sum_of_squares

    def counted(lengths, size):
        seen.add(int(len(lengths) > 300))
        return inner(lengths, size)

    monkeypatch.setattr(ss_packing, "sum_of_squares", counted)
    df = spark.range(2000).select(F.expr(own).alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 60 + 1).alias("length"))
    out = ss_packing.pack(df, 64, 100)
    assert out.columns == ["doc_id", "piece", "length", "sequence_id", "offset"] and out.count() == 2000
    assert seen.value == 0


def test_components_do_not_end_early(spark):
    path = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError):
        components.components(path, 2)
    assert components.components(path).select("component").distinct().count() == 1


def test_columns_of_any_name_are_kept(spark):
    names = ["doc_id", "piece", "length", "open", "row", "group", "own", "_group", "sequence_id", "offset"]
    df = spark.range(300).select(*(((F.col("id") % 60 + 1) if n == "length" else F.col("id")).alias(n) for n in names))
    out = ss_packing.pack(df, 64, 50)
    assert out.columns == [*names[:8], "sequence_id", "offset"]
    assert sorted(r["own"] for r in out.collect()) == list(range(300)) and all(r["open"] == r["row"] == r["_group"] == r["doc_id"] for r in out.collect())
    assert max(r["n"] for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()) <= 64


def test_hot_centres_are_looked_up_apart(spark):
    star = spark.range(1, 500).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b")).unionByName(spark.range(600, 640).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    got = {r["node"]: r["component"] for r in components.components(star, hot_least=1).collect()}
    assert got == {i: 0 for i in range(500)} | {i: 600 for i in range(600, 641)}
