"""Special tokens in texts, against a tokenizer read anew from its file and left as the library makes it."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recordloom.llm import chunk_table

PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "  ", "\n", "\t", "a", " b", "é", "'s", "1", ".", "\x01", "　", "́", "Σ"]
TABLES = {"byte_bpe_50k.json": chunk_table.byte_bpe, "word_bpe_49k.json": chunk_table.word_bpe}


def same(name, texts):
    fresh, (ids, at) = Tokenizer.from_file(chunk_table.tokenizer_path(name)), TABLES[name]().encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [fresh.encode(x, add_special_tokens=False).ids for x in texts]
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


@pytest.mark.parametrize("name", sorted(TABLES))
def test_special_tokens_are_the_library_s(name):
    got = same(name, ["end of part <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b", "x\n<|endoftext|>\n\ny", "<|startoftext|> x y z <|endoftext|>"])
    assert all({"byte_bpe_50k.json": 50256, "word_bpe_49k.json": 49407}[name] in x for x in got)


@pytest.mark.parametrize("name", sorted(TABLES))
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=8))
def test_special_tokens_beside_anything(name, texts):
    same(name, texts)
