"""What version control knows of files, read from its own: the index of a checkout, blob digests, ignore files.

The binary index is read by Spark like any other file, so it may lie in any store; each is one row, parsed where it is read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import relational as ops

TRACKED = "repo_id string, path string, mode int, stage int, blob string"


def entries(raw: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(path, mode, stage, blob) of an index of version 2, 3 or 4; ValueError where the bytes are none."""
    if len(raw) < 12 or raw[:4] != b"DIRC" or not 2 <= (version := struct.unpack(">I", raw[4:8])[0]) <= 4:
        raise ValueError("no index of version 2 to 4")
    at, path = 12, b""
    for _ in range(struct.unpack(">I", raw[8:12])[0]):
        start, mode, blob, flags = at, struct.unpack(">I", raw[at + 24 : at + 28])[0], raw[at + 40 : at + 60].hex(), struct.unpack(">H", raw[at + 60 : at + 62])[0]
        at += 64 if flags & 0x4000 else 62
        if version == 4:  # a number of bytes to drop from the path before, then what follows
            drop = raw[at] & 127
            while raw[at] & 128:
                at += 1
                drop = ((drop + 1) << 7) | (raw[at] & 127)
            at += 1
            end = raw.index(b"\0", at)
            path = path[: len(path) - drop] + raw[at:end]
            at = end + 1
        else:
            end = raw.index(b"\0", at)
            path, at = raw[at:end], start + (end - start + 8) // 8 * 8
        yield path.decode("utf-8", "replace"), mode, flags >> 12 & 3, blob


def tracked(indexes: DataFrame) -> DataFrame:
    """TRACKED rows of indexes (repo_id, content); one that can't be parsed gives none, as no checkout does."""

    def run(batches):
        for batch in batches:
            for repo, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = list(entries(raw or b""))
                except (ValueError, struct.error, IndexError):
                    continue
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([repo] * len(rows)), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True))], ["repo_id", "path", "mode", "stage", "blob"])

    return indexes.select("repo_id", "content").mapInArrow(run, TRACKED)


def load_indexes(spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
    """repo_id and content of the indexes of checkouts by id and folder; folders without one give no row."""
    out = [spark.read.format("binaryFile").option("pathGlobFilter", "index").load(f"{root.rstrip('/')}/.git/inde[x]").select(F.lit(repo).alias("repo_id"), "content") for repo, root in roots.items() if _there(spark, f"{root.rstrip('/')}/.git/index")]
    return ops.union_all(out) if out else spark.createDataFrame([], "repo_id string, content binary")


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


#: The format of a log that log_tables() reads: git log --all --format=...
LOG_FORMAT = "%H%x1f%P%x1f%an <%ae>%x1f%D"


def log_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """commits, heads and tags, as operators.history.statistics() takes them, of a log's lines (repo_id, line) in LOG_FORMAT."""
    parts = F.split("line", "\x1f")
    own = lines.where(F.size(parts) == 4).select("repo_id", parts[0].alias("id"), F.filter(F.split(parts[1], " "), lambda x: x != "").alias("parents"), parts[2].alias("author"), F.explode_outer(F.split(parts[3], ", ")).alias("ref"))
    tags = own.where(F.startswith("ref", F.lit("tag: "))).select("repo_id", F.expr("substring(ref, 6)").alias("tag"), "id")
    heads = own.where((F.col("ref") == "HEAD") | F.startswith("ref", F.lit("HEAD -> "))).select("repo_id", "id")
    return own.select("repo_id", "id", "parents", "author").distinct(), heads, tags


def blob(content: Column | str) -> Column:
    """The digest under which version control holds a file's bytes; line ends are taken as they are."""
    own = F.col(content) if isinstance(content, str) else content
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(own).cast("string"), F.lit("\0")).cast("binary"), own))


def states(files: DataFrame, known: DataFrame) -> DataFrame:
    """repo_id, path and state of files (repo_id, path, content) and TRACKED ones: clean, changed, untracked, lost or unmerged."""
    held = known.groupBy("repo_id", "path").agg(F.max("stage").alias("stage"), F.min("blob").alias("blob"))
    both = files.select("repo_id", "path", blob("content").alias("own")).join(held, ["repo_id", "path"], "full_outer")
    state = F.when(F.col("stage") > 0, "unmerged").when(F.col("blob").isNull(), "untracked").when(F.col("own").isNull(), "lost").when(F.col("own") == F.col("blob"), "clean").otherwise("changed")
    return both.select("repo_id", "path", state.alias("state"))


def folder_states(told: DataFrame, folders: DataFrame, heads: DataFrame, ignored: DataFrame) -> DataFrame:
    """What planning.retirement asks of folders (repo_id, folder): tracked, clean and head, from states(), heads (repo_id, head)
    and ignored paths (repo_id, path). A folder is clean if all files in it are tracked as they are and none is ignored."""
    inside = told.join(ignored.select("repo_id", "path", F.lit(True).alias("hidden")), ["repo_id", "path"], "left").withColumn("folder", F.explode(_above("path")))
    counts = inside.join(folders.select("repo_id", "folder").distinct(), ["repo_id", "folder"], "left_semi").groupBy("repo_id", "folder").agg(
        F.bool_or(F.col("state") != "untracked").alias("tracked"), F.bool_and((F.col("state") == "clean") & F.col("hidden").isNull()).alias("clean"))
    own = folders.select("repo_id", "folder").distinct().join(counts, ["repo_id", "folder"], "left").join(heads.select("repo_id", "head"), "repo_id", "left")
    return own.select("repo_id", "folder", F.coalesce("tracked", F.lit(False)).alias("tracked"), F.coalesce("clean", F.lit(False)).alias("clean"), "head")


def _above(path: str) -> Column:
    """The folders above a path, not itself."""
    parts = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def ignore_patterns(files: DataFrame) -> DataFrame:
    """repo_id, base (the folder of the file, empty at the top), nth (of the line), keep (a `!` line), folders (for these alone) and
    regex (of a path from base on) of the lines of .gitignore files (repo_id, path, content)."""
    own = files.where(F.col("path").rlike(r"(^|/)\.gitignore\z")).select("repo_id", F.regexp_extract("path", r"^(?:(.*)/)?\.gitignore\z", 1).alias("base"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("nth", "line"))
    own = own.withColumn("line", F.regexp_replace("line", r"(?<!\\)\s+\z", "")).where("line <> '' AND NOT startswith(line, '#')")
    keep = F.startswith("line", F.lit("!"))
    glob = F.regexp_replace(F.when(keep, F.expr("substring(line, 2)")).otherwise(F.col("line")), r"/\z", "")
    own = own.select("repo_id", "base", "nth", keep.alias("keep"), F.endswith("line", F.lit("/")).alias("folders"), glob.alias("glob"))
    # A slash before the end binds a pattern to its base; else it may stand in any folder below.
    bound = F.contains("glob", F.lit("/"))
    text = F.regexp_replace(F.regexp_replace("glob", "^/", ""), r"([.+(){}|^$])", r"\\$1")
    for old, new in ((r"\[!", "[^"), (r"^\*\*/", "\x01"), (r"/\*\*/", "\x02"), (r"/\*\*\z", "\x03"), (r"\*+", "[^/]*"), (r"\?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", "/(?:.*/)?"), ("\x03", "/.+")):
        text = F.regexp_replace(text, old, new)
    return own.select("repo_id", "base", "nth", "keep", "folders", F.concat(F.lit("(?s)\\A"), F.when(bound, "").otherwise("(?:.*/)?"), text, F.lit("\\z")).alias("regex"))


def ignored(paths: DataFrame, patterns: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Those of paths (repo_id, path) that ignore_patterns() hide; known: TRACKED ones, which are never hidden.

    A path or a folder above it is hidden if the last pattern that fits it, of the deepest file, hides; nothing below a hidden
    folder comes back. A path meets the patterns of the folders above it, by equality.
    """
    own = paths.select("repo_id", "path").distinct()
    if known is not None:
        own = own.join(known.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti")
    parts = F.split("path", "/")
    each = own.withColumn("deep", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumns({"part": F.array_join(F.slice(parts, 1, F.col("deep")), "/"), "is_folder": F.col("deep") < F.size(parts)})
    based = each.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("deep") - 1))).withColumns({"base": F.array_join(F.slice(parts, 1, F.col("level")), "/"), "below": F.array_join(F.slice(parts, F.col("level") + 1, F.col("deep") - F.col("level")), "/")})
    hits = based.join(patterns, ["repo_id", "base"]).where("below rlike regex AND (is_folder OR NOT folders)")
    last = hits.groupBy("repo_id", "path", "deep").agg(F.max_by("keep", F.struct("level", "nth")).alias("keep"))
    return last.where("NOT keep").select("repo_id", "path").distinct()
