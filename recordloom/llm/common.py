"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many bytes, which bounds a Python worker's memory.
SLICE_BYTES = 16 << 20


#: Folders that written() has made in this process, until drop_written().
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where a local session has none, as in tests, a temporary one.

    On a cluster without it this raises RuntimeError, for its executors share no other folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="recordloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts the lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables that written() has made so far in this process, when no result that rests on them is needed any more."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts are about `most` bytes long; a longer text has a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        if ends[-1] <= most:
            yield batch
            continue
        cut = np.flatnonzero(np.diff(ends // most, prepend=0)).tolist()
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


@contextmanager
def small_batches(spark: SparkSession, most: int = SLICE_BYTES) -> Iterator[None]:
    """What is run meanwhile goes to Python in batches of about `most` bytes.

    Spark bounds them by 10,000 rows and 64 MB, held by the executor, whose buffers grow by doubling, and by each Python
    worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(own)) if (own := before.rstrip("bB")).isdigit() and int(own) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def filtered(docs: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], list[bool]]]) -> DataFrame:
    """The rows of docs, with all their columns, whose texts pass; make() is called in each task and gives the function of texts.

    Columns go by their places, since mapInArrow can't take a name with a dot in it.
    """
    at = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches):
        passes = make()
        for batch in text_slices(batches, at):
            yield batch.filter(pa.array(passes(pc.cast(batch.column(at), pa.string())), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def by_text(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over slices of (id, text); make() is called once for each task and gives the function of a slice."""

    def run(batches):
        apply = make()
        for batch in text_slices(batches):
            yield apply(batch)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; a null text is an empty one."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only these two, so that further columns, whatever their names, reach no operator."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def tree_sum(df: DataFrame, column: str, fan: int = 16) -> np.ndarray | None:
    """The sum of equally long float64 vectors, held as binary, added up by tasks of `fan` rows each until one row is left.

    None if df has no row. No task and not the driver ever holds more than `fan` vectors.
    """

    def add(batches):
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = np.frombuffer(raw, np.float64)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], [column])

    df = written(df.select(column), "vectors")
    n = df.count()
    while n > 1:
        n = -(-n // fan)
        df = df.repartition(n).mapInArrow(add, f"{column} binary")
        if n > 1:
            df = written(df, "vectors")
            n = df.count()
    row = df.first()
    return None if row is None else np.frombuffer(row[0], np.float64)


