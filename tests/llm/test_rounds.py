"""Rounds that few links or one block don't need."""

import pyspark.sql.functions as F

from recordloom.llm import components as c
from recordloom.llm import linking
from recordloom.llm.common import written


def test_few_links_are_joined_without_a_shuffle(spark, monkeypatch):
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    links = written(spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")), "given")
    monkeypatch.setattr(c, "written", seen)
    found = c.components(links)
    assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(200)}
    assert len(plans) > 2 and not any("Exchange hash" in p for p in plans[1:])


def test_a_key_of_one_block_is_dealt_once(spark):
    # 300 rows of one key in three groups; the least row meets its own group first, one round joins the others.
    rows = spark.range(300).select(F.lit(7).cast("bigint").alias("h"), F.col("id").alias("row"), F.lit(0).cast("bigint").alias("place"))
    nodes, asked = spark.range(300).select(F.col("id").alias("row"), F.chr(65 + F.col("id") % 3).cast("binary").alias("sketch")), []

    def verify(pairs):
        asked.append(1)
        return written(pairs.where("a % 3 = b % 3"), "verified")

    found = linking.linked(rows, nodes, lambda place, one, places, others: (others == one).all(1), verify)
    assert {tuple(r) for r in found.collect()} == {(k, k % 3) for k in range(300)}
    assert len(asked) == 3
