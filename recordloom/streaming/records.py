"""Record rules over streams of files: the row-local ones as they stand, duplicates with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom import model
from recordloom.functions import text as t
from recordloom.operators import relational as ops


def evidence_stream(spark: SparkSession, folder: str, repo_id: str, per_trigger: int = 1000) -> DataFrame:
    """Evidence files as they arrive: repo_id, path, text, keys, data and seen_at."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", per_trigger).load(folder)
    own = files.select(F.lit(repo_id).alias("repo_id"), t.name("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("seen_at"))
    return own.select("*", F.json_object_keys("text").alias("keys"), F.from_json("text", model.EVIDENCE).alias("data"))


def evidence_problems(stream: DataFrame) -> DataFrame:
    """The row-local evidence rules; a projection, so it keeps no state."""
    missing = F.array_except(F.array(*map(F.lit, model.EVIDENCE_FIELDS)), "keys")
    whole = F.col("keys").isNotNull() & (F.size(missing) == 0)
    return ops.problems(
        stream,
        ("S1", F.col("keys").isNull(), "expected a JSON object"),
        ("P2", F.size(missing) > 0, F.concat(F.lit("missing evidence fields: "), F.array_join(F.sort_array(missing), ", "))),
        ("P6", whole & (F.col("data.id") != F.regexp_replace("path", r"\.json\z", "")), "evidence id must match filename"),
        ("P7", whole & ~t.is_timestamp(F.coalesce("data.timestamp", F.lit("None"))), "timestamp must be ISO 8601"),
    )


def first_of_each(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The first record of each id within the watermark; state older than that is dropped."""
    return stream.withColumn("id", F.col("data.id")).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["repo_id", "id"])
