"""A corpus in four stages: language ID, quality rules, near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes what a stage returns as
Parquet in the shared folder and reads it again as the next one's docs. All but the last return the columns of docs,
whatever others they have besides doc_id and text, and lang for the first.

Cases: null texts, empty ones and those without a letter go in the first stage, as do texts in no language that could be
learned; where no row has a lang, all with a letter stay. Short texts go in the second, by its base rule of 50 words.
Repeated rows and near copies are one group in the third, of which the row of the smallest id stays, one without an id
only where no row has one, and of equal ids the one that comes first. In the fourth each row is packed for itself,
whether its id is null or equal to another's. A very long text passes each stage whole and is cut into sequences by the
last alone. Each stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import language_id, near_copies, quality_rules, ss_packing
from recordloom.llm.common import written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learned from those with a non-null lang."""
    return language_id.keep(docs, language_id.train(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; copies share 0.8 of their five-word shingles.

    SimHash's vantage-point tree gives the links of fingerprints two bits apart, each held to that similarity; since copies
    just above it lie further apart than any tree of fingerprints can search, a join of prefixes finds the others.
    """
    return near_copies.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents' tokens goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = ss_packing.pieces(docs)
    return ss_packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32")))


STAGES = [("language_id", languages), ("quality_rules", rules), ("near_dedup", near_dedup), ("packing", packing)]
#: SQL can't express language models and packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
