"""Token ids in files: canonical, length-limited Huffman codes from global counts, decoded by table.

The file format is a Parquet table of segments, so that Spark commits, lists and reads it wherever it is stored. A
segment holds whole documents in ascending order of their ids, at least SEGMENT ids where there are as many:

    bucket, segment   place in the whole order: buckets are ranges of doc_id, segments are numbered within
    base              ids before it in its bucket
    doc_ids, lengths  its documents and how many ids each has
    payload           the codes' bits, most significant first, filled up to 64
    checkpoints       little-endian unsigned 64-bit: the bit offset of each BLOCK of ids, which is decoded by itself

Beside it lies the table of code lengths (id, bits), from which the codes follow: shorter first, then by id.

Cases: a null text is an empty one, and an empty document still has its end id; ids may be of any type that can be
ordered, and a null one comes first; rows with equal ids are ordered by hashes of their texts, then by these, and a
frequent id has several buckets by those hashes; a very long text is a segment of its own; codes of equal length follow
the order of ids; an empty table gives empty tables; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_table import byte_bpe
from .common import id_and_text, shared_dir, text_slices, written

TOKENIZER, END = "byte_bpe_50k.json", 2
#: Ids in a segment at least, ids in a block, the longest code in bits, and ranges of doc_id at most.
SEGMENT, BLOCK, LIMIT, BUCKETS = 1 << 18, 128, 18, 8192


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code, 0 where its count is 0, the least total with no code over `limit` (package-merge)."""
    used = np.flatnonzero(counts)
    n = len(used)
    bits = np.zeros(len(counts), np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit in codes of {limit} bits")
    if n <= 1:
        bits[used] = 1
        return bits
    order = used[np.argsort(counts[used], kind="stable")]
    leaves, packages, levels = counts[order].astype(np.float64), np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take, own = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        own[:k] += 1
        take = 2 * (take - k)
    bits[order] = own
    return bits


def codes(bits: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol that has one."""
    out, code, last = np.zeros(len(bits), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(bits)), bits))
    for i in order[bits[order] > 0].tolist():
        code <<= int(bits[i]) - last
        out[i], last = code, int(bits[i])
        code += 1
    return out


def decoding_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each window of as many bits as the longest code: the symbol at its start and that symbol's bits."""
    width = max(1, int(bits.max(initial=0)))
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    spans = 1 << (width - bits[order])
    symbols, sizes = np.zeros(1 << width, np.int32), np.ones(1 << width, np.int64)
    total = int(spans.sum())
    symbols[:total], sizes[:total] = np.repeat(order, spans), np.repeat(bits[order], spans)
    return symbols, sizes, width


def pack_bits(ids: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload and the bit offset of each block."""
    size = bits[ids]
    ends = np.cumsum(size)
    at = ends - size
    words = np.zeros((int(ends[-1]) if len(ends) else 0) // 64 + 2, np.uint64)
    if len(ids):
        word, room, value = at >> 6, 64 - (at & 63) - size, code[ids]
        whole = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        words[word[first]] = np.bitwise_or.reduceat(whole, first)
        over = room < 0
        words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes(), at[::BLOCK].astype("<u8")


def unpack_bits(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids again: all blocks take a step at once, each from its own checkpoint."""
    symbols, sizes, width = table
    raw = np.frombuffer(payload, np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, out, last = checkpoints.astype(np.int64), np.empty((BLOCK, len(checkpoints)), np.int32), len(window) - 1
    for k in range(BLOCK):
        seen = (window[np.minimum(at >> 3, last)] >> (32 - width - (at & 7)).astype(np.uint32)) & np.uint32((1 << width) - 1)
        out[k] = symbols[seen]
        at += sizes[seen]
    return out.T.reshape(-1)[:n]


@dataclass
class IdFiles:
    """Where the segments and the code lengths lie, and the type of the ids of documents."""

    segments: str
    lengths: str
    kind: str


_DOCS = "bucket int, segment int, base bigint, doc_ids array<{}>, lengths array<bigint>"
#: Ids of documents looked at for each bucket, to find their ranges.
LOOKED_AT = 50


def _buckets(docs: DataFrame) -> tuple[int, list[tuple]]:
    """How many buckets there are at most, and where they begin: (doc_id, hash), of about equal numbers of rows.

    From a sample of ids. An id that has more rows than a bucket gets several of them, by even ranges of hashes.
    """
    spark, total = docs.sparkSession, docs.count()
    n = min(BUCKETS, max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rate = int(min(1.0, LOOKED_AT * n / max(1, total)) * (1 << 30))
    # Of rows, not of ids, so that a frequent id shows; a row's number is only good for that.
    few = docs.select("doc_id").where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) < rate).groupBy("doc_id").count().collect()
    few, seen, bounds = sorted(((r[0] is not None, r[0], r[1]) for r in few), key=lambda x: (x[0], x[1]) if x[0] else (x[0],)), 0, []
    share = sum(x[2] for x in few) / n
    for _, doc, k in few:
        parts = int(-(-k // share)) if k > share else 0
        if parts:
            bounds += [(doc, -(1 << 63) + (1 << 64) * i // parts) for i in range(parts)]
            seen = 0
        elif seen >= share:
            bounds.append((doc, -(1 << 63)))
            seen = k
        else:
            seen += k
    return n, bounds


def _raw_segments(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Segments with plain ids, from documents dealt to ranges of doc_id and sorted within."""
    (n, bounds), kind = _buckets(docs), docs.schema["doc_id"].dataType.simpleString()
    docs = docs.withColumn("hash", F.xxhash64("text"))
    own = F.struct("doc_id", "hash")
    starts = F.array(*(F.struct(F.lit(doc).cast(kind).alias("doc_id"), F.lit(h).cast("bigint").alias("hash")) for doc, h in bounds))
    # The bucket is the number of bounds at or below a row; a null id is less than any other.
    bucket = F.size(F.filter(starts, lambda x: x <= own)) if bounds else F.lit(0)

    def run(batches):
        table = byte_bpe(tokenizer)
        place, number, base, total, held, ids, sizes, id_type = None, 0, 0, 0, [], [], [], None

        def segment():
            nonlocal number, base, total
            own = np.concatenate(ids)
            width = 4 if own.max() > 65535 else 2
            sink = pa.BufferOutputStream()
            with pa.CompressedOutputStream(sink, "lz4") as out:
                out.write(own.astype(f"<u{width}").tobytes())
            row = [[place], [number], [base], [list(held)], [list(sizes)], [sink.getvalue().to_pybytes()], [width]]
            number, base, total = number + 1, base + len(own), 0
            held.clear(), ids.clear(), sizes.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["bucket", "segment", "base", "doc_ids", "lengths", "raw", "width"])

        for batch in text_slices(batches):
            id_type = batch.column(0).type
            got, at = table.encode(batch.column(1))
            for i, (doc, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if b != place:
                    if ids:
                        yield segment()
                    place, number, base = b, 0, 0
                own = np.append(got[at[i] : at[i + 1]], np.int32(end))
                held.append(doc), ids.append(own), sizes.append(len(own))
                total += len(own)
                if total >= SEGMENT:
                    yield segment()
        if ids:
            yield segment()

    dealt = docs.withColumn("bucket", bucket.cast("int")).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "hash", "text")
    return dealt.select("doc_id", "text", "bucket").mapInArrow(run, f"{_DOCS.format(kind)}, raw binary, width int")


def _plain(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(pa.input_stream(pa.py_buffer(raw), compression="lz4").read(), f"<u{width}")


def write(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end: int = END) -> IdFiles:
    """Tokenizes the documents, each followed by `end`, and writes their ids; path: by default a new one in the shared folder."""
    spark = docs.sparkSession
    df = id_and_text(docs, id_col, text_col)
    top = path or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    files = IdFiles(f"{top}/segments", f"{top}/lengths", df.schema["doc_id"].dataType.simpleString())
    segments = written(_raw_segments(df, tokenizer, end), "raw-ids", "uncompressed")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.bincount(_plain(raw, width))
                total, own = (total, own) if len(total) >= len(own) else (own, total)
                total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    # At most as many rows as the tokenizer has ids.
    counted = segments.select("raw", "width").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    bits = code_lengths(counts)
    spark.createDataFrame([(int(i), int(bits[i])) for i in np.flatnonzero(bits)], "id int, bits int").coalesce(1).write.parquet(files.lengths)

    def code(batches):
        own = codes(bits)
        for batch in batches:
            payloads, marks = [], []
            for raw, width in zip(batch.column("raw").to_pylist(), batch.column("width").to_pylist(), strict=True):
                payload, checkpoints = pack_bits(_plain(raw, width).astype(np.int64), own, bits)
                payloads.append(payload), marks.append(checkpoints.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(payloads, pa.binary()), pa.array(marks, pa.binary())], [*batch.schema.names[:5], "payload", "checkpoints"])

    segments.mapInArrow(code, f"{_DOCS.format(files.kind)}, payload binary, checkpoints binary").sortWithinPartitions("bucket", "segment").write.option("compression", "uncompressed").parquet(files.segments)
    return files


def read(spark: SparkSession, files: IdFiles) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and tokens (little-endian unsigned 32-bit) of each document."""
    bits = {r["id"]: r["bits"] for r in spark.read.parquet(files.lengths).collect()}
    lengths = np.zeros(max(bits, default=0) + 1, np.int64)
    for i, b in bits.items():
        lengths[i] = b
    segments = spark.read.schema(f"{_DOCS.format(files.kind)}, payload binary, checkpoints binary").parquet(files.segments)
    # One row for each bucket, BUCKETS at most.
    ends = segments.groupBy("bucket").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).collect()
    before, total = {}, 0
    for r in sorted(ends, key=lambda r: r["bucket"]):
        before[r["bucket"]] = total
        total += r["n"]

    def decode(batches):
        table = decoding_table(lengths)
        for batch in batches:
            for bucket, _, base, docs, sizes, payload, marks in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n = np.array(sizes, np.int64)
                ids = unpack_bits(payload, np.frombuffer(marks, "<u8"), int(n.sum()), table).astype("<u4").tobytes()
                end = np.cumsum(n)
                tokens = [ids[4 * a : 4 * b] for a, b in zip((end - n).tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(3).type.value_type), pa.array(before[bucket] + base + end - n), pa.array(n), pa.array(tokens, pa.binary())], ["doc_id", "start", "n_tokens", "tokens"])

    return segments.mapInArrow(decode, f"doc_id {files.kind}, start bigint, n_tokens bigint, tokens binary")

