"""Ids by way of pieces are those that an untouched tokenizer gives for whole texts."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from recordloom.llm import chunk_table

PARTS = ["a", "b", "the", "é", "ß", "ſ", "'s", "'", "\n", "\n\n", " ", "  ", "\t", "1", "23", ",", ".", "<|endoftext|>", "<|", "ª", "²", "œ", "漢", " ", "　", "▁", "_", "×", "÷", "``", "it's", "\r", "\x00", "!?", "DON'T", "'ll"]


@pytest.mark.parametrize("make, name", [(chunk_table.byte_bpe, "byte_bpe_50k.json"), (chunk_table.word_bpe, "word_bpe_49k.json")])
def test_ids_are_the_librarys(make, name):
    rng = random.Random(5)
    texts = ["", *("".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(4000)), "x" * 50_000 + " y," * 5000]
    library = Tokenizer.from_file(chunk_table.tokenizer_path(name))
    for _ in range(2):  # the second time from the table
        ids, at = make().encode(pa.array(texts))
        for text, a, b in zip(texts, at, at[1:], strict=False):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_a_small_table_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(chunk_table, "REMEMBERED", 7)
    chunk_table.byte_bpe.cache_clear()
    table, library = chunk_table.byte_bpe(), Tokenizer.from_file(chunk_table.tokenizer_path("byte_bpe_50k.json"))
    for k in range(30):
        text = " ".join(f"word{'x' * (i * k % 11)}, and{i}." for i in range(40))
        ids, _ = table.encode(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(table.known) <= 7 and len(table.older) <= 7
    chunk_table.byte_bpe.cache_clear()


def test_a_tokenizer_that_parts_otherwise_has_no_pieces():
    assert chunk_table._byte_pieces(Tokenizer.from_file(chunk_table.tokenizer_path("word_bpe_49k.json"))) == (None, None)


def test_pieces_by_array_operations_are_those_of_the_pattern():
    chunk_table.byte_bpe.cache_clear()
    table, rng = chunk_table.byte_bpe(), random.Random(7)
    chunks = ["", " ", "\n", " a", " a\nb,c1é", "a\n", *("".join(rng.choices(PARTS, k=rng.randint(0, 6))) for _ in range(5000))]
    done, pieces, first = table.parted(pa.array(chunks, pa.string()).slice(1))
    own = [x for x, yes in zip(chunks[1:], done, strict=True) if yes]
    pieces, ends = pieces.to_pylist(), [*first.tolist()[1:], len(pieces)]
    assert not len(table.parted(pa.array(["it's", "漢"]))[2])
    assert len(own) > 500 and {" ", "\n", " a\nb,c1é", "a\n"} <= set(own)
    for chunk, a, b in zip(own, first.tolist(), ends, strict=True):
        assert pieces[a:b] == table.pieces(chunk), chunk


def test_each_distinct_piece_is_looked_up_once():
    chunk_table.byte_bpe.cache_clear()
    table, calls = chunk_table.byte_bpe(), []
    inner = table.pieces
    table.pieces = lambda chunk: calls.append(chunk) or inner(chunk)
    text = " ".join(f"word{'abcdefghij'[i % 10]},\nand{'!' * i}" for i in range(300))
    ids, _ = table.encode(pa.array([text]))
    assert ids.tolist() == Tokenizer.from_file(chunk_table.tokenizer_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert not calls  # no chunk is parted by itself
    chunk_table.byte_bpe.cache_clear()
