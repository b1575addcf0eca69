"""Packing of token sequences by the sum-of-squares rule.

Documents are tokenized, given an end id and cut only where longer than a sequence. Each piece goes into the open bin
(or a new one) that leaves the sum over residual gaps g of N(g)^2 smallest, N(g) being the open bins with gap g; the
pieces of a group come in order of falling length.

Pieces are numbered when they are written and dealt to groups by a hash of that number, about GROUP in each, so that
every group has the lengths of the whole corpus and no group is large. What a group leaves in bins that aren't full is
dealt anew, into fewer and fewer groups, until one is left or nothing changes: the last round packs only what all the
others left over.

Cases: a null text is an empty one, and an empty document still has its end id; a very long text is cut into as many
pieces as it needs; equal rows are packed each for itself; pieces of one length go in the order of their numbers, and of
gaps that are equally good the smallest is taken, an open bin only where it is better than a new one; an empty table
gives an empty one; other columns of the documents are ignored by pieces(), and all columns, whatever their names, are
kept by pack(), but for sequence_id and offset, which it gives anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunk_table import word_bpe
from .common import id_and_text, text_slices, written

TOKENIZER, END, SIZE = "word_bpe_49k.json", 1, 4096
#: Pieces in a group, about. Rows of it are some 60 bytes, so a group is below 1 MB.
GROUP = 8192
#: Rounds at most, so that a round's number has 6 bits; each leaves about a tenth.
ROUNDS = 64


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end: int = END, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length and tokens (little-endian unsigned 32-bit ids) of each piece of at most `size` tokens."""

    def run(batches):
        table = word_bpe(tokenizer)
        for batch in text_slices(batches):
            ids, at = table.encode(batch.column(1))
            bounds, rows, piece, start, length, tokens = at.tolist(), [], [], [], [], []
            for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                own = np.append(ids[a:b], end).astype("<u4")
                for k, s in enumerate(range(0, len(own), size)):
                    x = own[s : s + size]
                    rows.append(i), piece.append(k), start.append(s), length.append(len(x)), tokens.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.binary())], ["doc_id", "piece", "start", "length", "tokens"])

    df = id_and_text(docs, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, tokens binary")


def sum_of_squares(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the gap left in each bin. Pieces are placed in the order given."""
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1, np.int64)  # N(g); a full bin counts nowhere
    bins, offsets, gaps = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i, n in enumerate(lengths.tolist()):
        # Into gap g: N(g) falls and N(g - n) rises by one, so the sum changes by 2 (N(g - n) - N(g)) + 2, or 1 - 2 N(g) if full then.
        change = 2 * (count[: size + 1 - n] - count[n:]) + 2
        change[0] = 1 - 2 * count[n]
        change[count[n:] == 0] = np.iinfo(np.int64).max
        # A new bin: N(size - n) rises by one, if it isn't full at once.
        fresh = 2 * count[size - n] + 1 if n < size else 0
        g = int(change.argmin()) + n
        if change[g - n] < fresh:
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            b, g = len(gaps), size
            gaps.append(size)
        bins[i], offsets[i] = b, size - g
        gaps[b] = g = g - n
        if g:
            open_bins[g].append(b)
            count[g] += 1
    return bins, offsets, np.array(gaps, np.int64)


def _placing(groups: int, last: bool, number: int, size: int):
    def place(rows: pa.Table) -> pa.Table:
        group = rows["group"][0].as_py()
        rows = rows.drop_columns("group").sort_by([("length", "descending"), ("row", "ascending")])
        bins, offsets, gaps = sum_of_squares(rows["length"].to_numpy(), size)
        # Round, group and bin as one number; rounds are few, for each leaves a small part.
        rows = rows.append_column("sequence_id", pa.array(((bins * groups + group) << 6) | number))
        rows = rows.append_column("offset", pa.array(offsets))
        return rows.append_column("open", pa.array((gaps[bins] > 0) & (not last)))

    return place


def pack(lengths: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """The columns of `lengths` with sequence_id and offset. It has length (1 to `size`) of each piece."""
    # The caller's columns are one struct, so that no name of theirs meets one of these.
    own = F.struct(*(F.col(f"`{c}`") for c in lengths.columns if c not in ("sequence_id", "offset")))
    todo = written(lengths.select(own.alias("own"), F.col("length").cast("bigint").alias("length"), F.monotonically_increasing_id().alias("row")), "pieces")
    n, left, done, number = todo.count(), None, None, 0
    schema = T.StructType([*todo.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("open", T.BooleanType())])

    while True:
        groups, last = max(1, -(-n // group)), n <= group or n == left or number == ROUNDS - 1

        dealt = todo.withColumn("group", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(groups)))
        placed = written(dealt.groupBy("group").applyInArrow(_placing(groups, last, number, size), schema), "placed")
        shut = placed.where("not open").select("own.*", "sequence_id", "offset")
        done = shut if done is None else done.unionByName(shut)
        if last:
            return done
        todo, left, number = placed.where("open").select("own", "length", "row"), n, number + 1
        n = todo.count()
        if n == 0:
            return done
