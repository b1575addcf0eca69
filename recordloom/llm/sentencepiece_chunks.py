"""SentencePiece encoding and decoding with a distinct-chunk table.

Pieces of the vocabulary never cross a white-space marker, so each distinct marked word of a slice of texts is
segmented once, by the sentencepiece library, and its ids are joined back by position. Nothing is shuffled: the table
belongs to a Python worker and is bounded (chunk_table.REMEMBERED); a word that it has dropped is segmented again.

Cases: a null text is an empty one, and an empty text has no ids; repeated rows and ids stay as they are; an empty
table gives an empty one; other columns of the input are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .chunk_table import piece_bpe
from .common import id_and_text, text_slices

MODEL = "piece_bpe_32k.model"
#: Bytes of a slice, about.
SLICE = 8 << 20


def _encoded(batch: pa.RecordBatch, model: str) -> pa.RecordBatch:
    ids, at = piece_bpe(model)[0].encode(batch.column(1))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["doc_id", "ids"])


def _decoded(batch: pa.RecordBatch, model: str) -> pa.RecordBatch:
    sp = piece_bpe(model)[1]
    # A text at a time: Python's integers take many times the room of the array's.
    texts = [sp.decode(x.values.tolist()) if x.is_valid and len(x) else "" for x in batch.column(1)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id and ids (array of int) of each row, equal to the library's encode() of the whole text."""
    df = id_and_text(docs, id_col, text_col)
    return df.mapInArrow(lambda batches: (_encoded(b, model) for b in text_slices(batches, most=SLICE)), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids and text: the library's decode() of each row's ids; null ids are no ids."""
    df = encoded.select("doc_id", "ids")
    return df.mapInArrow(lambda batches: (_decoded(b, model) for b in batches), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """decode(encode(docs)) in one Python worker: ids needn't go to Spark and back, nor a second worker stand by."""
    df = id_and_text(docs, id_col, text_col)
    return df.mapInArrow(lambda batches: (_decoded(_encoded(b, model), model) for b in text_slices(batches, most=SLICE)), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")
