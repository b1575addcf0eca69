"""Record repositories as one relation of their files and folders."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as t
from recordloom.model import TREE
from recordloom.operators.relational import union_all

#: Cases, about, for which one task copies a content.
CASES = 1024


def with_folders(files: DataFrame) -> DataFrame:
    """tree from (repo_id, path, content): folders are the prefixes of the paths; a path ending in `/` is an empty folder.

    top, the first folder of a path or an empty text, is a column of the files if it is given: where it is a constant of
    each part of a union, a filter of it leaves out whole parts.
    """
    if "top" not in files.columns:
        files = files.withColumn("top", F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(""))
    parts = F.split(F.rtrim("path", F.lit("/")), "/")
    deep = F.size(parts) - F.when(F.col("path").endswith("/"), 0).otherwise(1)
    above = F.when(deep > 0, F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    folders = files.select("repo_id", "top", F.explode(above).alias("path")).distinct().select("repo_id", "path", F.lit(None).cast("binary").alias("content"), F.lit(True).alias("is_dir"), "top")
    own = files.where(~F.col("path").endswith("/")).select("repo_id", "path", "content", F.lit(False).alias("is_dir"), "top")
    top = files.select("repo_id").distinct().select("repo_id", F.lit(".").alias("path"), F.lit(None).cast("binary").alias("content"), F.lit(True).alias("is_dir"), F.lit("").alias("top"))
    return union_all([own, folders, top]).withColumns({"parent": t.parent("path"), "name": t.name("path"), "text": F.when(~F.col("is_dir"), F.decode("content", "UTF-8"))})


def load(spark: SparkSession, roots: Mapping[str, str], glob: str | None = None) -> DataFrame:
    """tree of repositories by id and folder, in one scan of all folders; glob restricts the files' names at the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    plain = {repo: ("/" + root.split("://")[-1].strip("/") if "://" in root else os.path.abspath(root)) for repo, root in roots.items()}
    files = reader.load(list(roots.values())).select(F.split(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), "/").alias("parts"), "content")
    # A file belongs to the root that its first parts name; of roots in one another, both have it.
    out = []
    for deep in sorted({x.count("/") + 1 for x in plain.values()}):
        own = spark.createDataFrame([(repo, x) for repo, x in plain.items() if x.count("/") + 1 == deep], "repo_id string, root string")
        at = files.select(F.array_join(F.slice("parts", 1, deep), "/").alias("root"), F.array_join(F.slice("parts", deep + 1, F.greatest(F.size("parts"), F.lit(1))), "/").alias("path"), "content")
        out.append(at.join(own, "root").select("repo_id", "path", "content"))
    return with_folders(union_all(out))


def from_texts(spark: SparkSession, repos: Mapping[str, Mapping[str, str | bytes | None]]) -> DataFrame:
    """tree of repositories given as {repo_id: {path: text}}; a path ending in `/` is an empty folder."""
    rows = [(repo, path, x if isinstance(x, bytes | type(None)) else x.encode(), False) for repo, files in repos.items() for path, x in files.items()]
    return with_folders(spark.createDataFrame(rows, TREE).drop("is_dir"))


def overlay_refs(base: DataFrame, over: DataFrame, skip: str = "meta.json") -> tuple[DataFrame, DataFrame]:
    """Files of cases by content address: (repo_id, path, digest, part) and the contents (digest, content), each once.

    base has the files of one repository, without repo_id; over has those of all cases, one row at least for each. A
    case's own files replace those of the base; `skip` is dropped. Cases are dealt to parts of about CASES, by which the
    base's rows of digests meet them; contents stay where they are. A file without content has no digest.
    """
    cases = over.select("repo_id").distinct()
    parts = -(-max(1, cases.count()) // CASES)
    part, digest = F.pmod(F.xxhash64("repo_id"), F.lit(parts)).cast("int").alias("part"), F.sha2("content", 256).alias("digest")
    own = over.where((F.col("path") != skip) & F.col("path").isNotNull())
    dealt = base.select("path", digest, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    under = cases.select("repo_id", part).join(dealt, "part").join(own.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    files = under.select("repo_id", "path", "digest", "part").unionByName(own.select("repo_id", "path", digest, part))
    contents = base.select(digest, "content").unionByName(own.select(digest, "content"))
    return files, contents.where("digest IS NOT NULL").groupBy("digest").agg(F.first("content").alias("content"))


def with_contents(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Files (repo_id, path, content) from overlay_refs: a content goes once to each part of cases that has it."""
    wanted = files.where("digest IS NOT NULL").select("digest", "part").distinct()
    return files.join(contents.join(wanted, "digest"), ["digest", "part"], "left").select("repo_id", "path", "content")


def overlay(base: DataFrame, over: DataFrame, skip: str = "meta.json") -> DataFrame:
    """Files (repo_id, path, content) of cases over a base, as overlay_refs has them, with their contents."""
    return with_contents(*overlay_refs(base, over, skip))


def text_lines(files: DataFrame) -> DataFrame:
    """repo_id, path, pos (from 1) and line of each line of the texts."""
    return files.where(F.col("text").isNotNull()).select("repo_id", "path", F.posexplode(t.lines("text")).alias("_p", "line")).select("repo_id", "path", (F.col("_p") + 1).alias("pos"), "line")
