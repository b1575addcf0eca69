"""Token ids of whole texts by way of a table of distinct chunks.

A text is cut where no token can cross: before a space between two other characters. Each distinct chunk of a slice of
texts is segmented once by the tokenizer's own library, whole or by the pieces that the library would part it into, and
its ids are put back by position with array operations.
A bounded table of chunks is kept from slice to slice in the Python worker; what isn't in it is segmented again.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker remembers between so many chunks and twice as many from slice to slice; the longest of them in characters.
REMEMBERED, LONGEST = 250_000, 64


def _joined_rows(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
    return np.frombuffer(b"".join(rows), np.int32), np.cumsum(lengths) - lengths, lengths


def _gathered(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that begin there, one after the other, and where each ends."""
    ends = np.cumsum(sizes)
    place = np.repeat((begin - (ends - sizes)).astype(np.int32), sizes)
    place += np.arange(len(place), dtype=np.int32)
    return flat[place], ends


class ChunkTable:
    """encode(texts) gives all ids and each text's offsets into them.

    segment: distinct chunks to (ids one after the other, number of ids of each).
    unsafe: for parts, as an array and as strings, whether a space beside one may lie within a token; `cut` then cuts
    the text exactly.
    first: how the first chunk of a text is marked; later ones are marked by a space.
    pieces: a chunk's pieces, of which the tokenizer segments each by itself, or None where that isn't known; `one` gives
    a piece's ids. The table then holds pieces in place of such chunks.
    parted: for an array of chunks, which of them it parts, their pieces one after the other, and where each begins; the
    same pieces as `pieces` gives, by array operations, and each distinct one is looked up once for a slice.
    """

    def __init__(self, segment: Callable, unsafe: Callable, cut: Callable[[str], list[str]], first: str = "", pieces: Callable[[str], list[str] | None] | None = None, one: Callable[[str], bytes] | None = None, parted: Callable[[pa.Array], tuple] | None = None):
        self.segment, self.unsafe, self.cut, self.first, self.pieces, self.one, self.parted = segment, unsafe, cut, first, pieces or (lambda chunk: None), one, parted
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def remember(self, chunk: str, row: bytes) -> None:
        if len(chunk) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[chunk] = row

    def piece(self, piece: str) -> bytes:
        row = self.known.get(piece)
        if row is None:
            row = self.older.get(piece)
            row = self.one(piece) if row is None else row
            self.remember(piece, row)
        return row

    def table(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of these chunks one after the other, where each starts, and how many it has."""
        if not self.parted or not chunks:
            return self.looked_up(chunks)
        done, pieces, first = self.parted(pa.array(chunks, pa.string()))
        flat, begin, length = self.looked_up([chunks[i] for i in np.flatnonzero(~done).tolist()])
        if not len(first):
            return flat, begin, length
        coded = pieces.dictionary_encode()
        at, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = list(map(self.known.get, names))
        for i in [i for i, x in enumerate(rows) if x is None]:
            row = self.older.get(names[i])
            rows[i] = row = self.one(names[i]) if row is None else row
            self.remember(names[i], row)
        own, starts, sizes = _joined_rows(rows)
        ids, ends = _gathered(own, starts[at], sizes[at])
        # Places and lengths of both kinds, in the order of the chunks.
        starts, lengths = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        edges = np.append(np.append(0, ends)[first], len(ids))
        starts[done], lengths[done] = edges[:-1], np.diff(edges)
        starts[~done], lengths[~done] = begin + len(ids), length
        return np.concatenate([ids, flat]), starts, lengths

    def looked_up(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`table` of chunks that aren't parted by array operations."""
        rows, new = list(map(self.known.get, chunks)), []
        for i in [i for i, x in enumerate(rows) if x is None]:
            if (row := self.older.get(chunks[i])) is not None:
                self.known[chunks[i]] = rows[i] = row
            elif (pieces := self.pieces(chunks[i])) is not None:
                rows[i] = b"".join(map(self.piece, pieces))
            else:
                new.append(i)
        if new:
            fresh = [chunks[i] for i in new]
            ids, lengths = self.segment(fresh)
            raw, ends = ids.astype(np.int32).tobytes(), (np.cumsum(lengths) * 4).tolist()
            for i, chunk, a, b in zip(new, fresh, [0, *ends], ends, strict=False):
                rows[i] = row = raw[a:b]
                self.remember(chunk, row)
        return _joined_rows(rows)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ")
        n = np.diff(parts.offsets.to_numpy())
        coded = parts.flatten().dictionary_encode()
        del parts
        at, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        starts = np.cumsum(n) - n
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        bad = self.unsafe(coded.dictionary, words)
        odd = (np.add.reduceat(bad[at], starts) > 0) & ~empty if len(n) else np.zeros(0, bool)
        # A chunk's key has its mark, so that the first chunk of a text and a later one differ where the library's do.
        index = {}
        keys: list[str] = []

        def of(key: str, index=index, keys=keys) -> int:
            i = index.get(key)
            if i is None:
                i = index[key] = len(keys)
                keys.append(key)
            return i

        plain = ~(odd | empty)
        used = np.zeros(len(words), bool)
        inner = np.repeat(plain, n)
        if self.first != " ":
            inner[starts] = False
        used[at[inner]] = True
        code = np.full(len(words), -1, np.int32)
        kept = np.flatnonzero(used)
        del inner, coded
        keys += [" " + words[i] for i in kept.tolist()]
        code[kept] = np.arange(len(kept))
        if odd.any():
            index.update(zip(keys, range(len(keys)), strict=True))
        seq = code[at]
        if self.first != " ":
            for i in np.flatnonzero(plain).tolist():
                seq[starts[i]] = of(self.first + words[at[starts[i]]])
        if odd.any() or empty.any():
            pieces = []
            for i, (a, k) in enumerate(zip(starts.tolist(), n.tolist(), strict=True)):
                if empty[i]:
                    pieces.append(np.zeros(0, np.int32))
                elif odd[i]:
                    pieces.append(np.array([of(x) for x in self.cut(texts[i].as_py())], np.int32))
                else:
                    pieces.append(seq[a : a + k])
            n = np.array([len(x) for x in pieces], np.int64)
            seq = np.concatenate(pieces) if pieces else seq
        del at, words, index
        flat, begin, length = self.table(keys)
        del keys
        ids, ends = _gathered(flat, begin[seq], length[seq])
        pa.default_memory_pool().release_unused()
        return ids, np.concatenate([[0], np.append(0, ends)[np.cumsum(n)]]).astype(np.int64)


def _flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(n.sum())), n


def _joined(tokenizer, between: str, mark: int, plain: Callable[[str], bool], group: int = 4096) -> Callable:
    """Chunks encoded many at a time, joined by a text that becomes the id `mark`.

    A plain chunk may hold `between` inside, as lines of a text do, if it becomes that id there as well; chunks that
    aren't plain are encoded one by one.
    """

    def one_by_one(chunks: list[str]):
        return _flattened([e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])

    def segment(chunks: list[str]):
        ids, sizes = [], np.zeros(len(chunks), np.int64)
        easy = np.fromiter(map(plain, chunks), bool, len(chunks))
        order = np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)])
        for a in range(0, len(order), group):
            part = order[a : a + group]
            texts = [chunks[i] for i in part.tolist()]
            if easy[part].all():
                # The fast form gives no offsets, the same ids.
                got = np.array(tokenizer.encode_batch_fast([between.join(texts)], add_special_tokens=False)[0].ids, np.int32)
                marks = np.flatnonzero(got == mark)
                within = np.fromiter((x.count(between) for x in texts), np.int64, len(texts))
                if len(marks) == len(texts) - 1 + within.sum():
                    marks = marks[np.cumsum(within[:-1] + 1) - 1]
                    sizes[part] = np.diff(np.concatenate([[-1], marks, [len(got)]])) - 1
                    ids.append(np.delete(got, marks))
                    continue
            got, sizes[part] = one_by_one(texts)
            ids.append(got)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        if easy.all():
            return flat, sizes
        # back to the order of the chunks
        starts = np.empty(len(chunks), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        ends = np.cumsum(sizes)
        return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])], sizes

    return segment


_EDGE = re.compile(r"(?<=\S) (?=\S)")


def _edges(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which parts are empty, and the first and last byte of each."""
    at = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]
    data = np.frombuffer(parts.buffers()[2] or b"\0", np.uint8)
    top = len(data) - 1
    return at[1:] == at[:-1], data[np.minimum(at[:-1], top)], data[np.clip(at[1:] - 1, 0, top)]


_ASCII_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])


def _loose(parts: pa.Array, words: list[str]) -> np.ndarray:
    """Empty parts, and those with white space at an edge; Python's has all that the tokenizers know."""
    empty, first, last = _edges(parts)
    out = empty | _ASCII_SPACE[first] | _ASCII_SPACE[last]
    for i in np.flatnonzero(~empty & ((first >= 128) | (last >= 128))).tolist():
        out[i] = words[i][0].isspace() or words[i][-1].isspace()
    return out


def _marked(parts: pa.Array, words: list[str]) -> np.ndarray:
    """Empty parts, and those with a marker at their end."""
    empty, _, last = _edges(parts)
    for i in np.flatnonzero(last == "▁".encode()[-1]).tolist():
        empty[i] |= words[i].endswith("▁")
    return empty


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def _library(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def _plain(tokenizer, fits: Callable[[str], object]) -> Callable[[str], bool]:
    """Chunks that may be joined: those that `fits` takes and that hold no added token, at which the library parts a text.

    Raises ValueError where an added token has white space or takes some beside it, so that a cut could part it.
    """
    added = list(tokenizer.get_added_tokens_decoder().values())
    if any(x.lstrip or x.rstrip or x.single_word or x.normalized or re.search(r"\s", x.content) for x in added):
        raise ValueError("added tokens of this tokenizer depend on the white space beside them")
    if not added:
        return lambda x: fits(x) is not None
    holds = re.compile("|".join(re.escape(x.content) for x in added)).search
    return lambda x: fits(x) is not None and holds(x) is None


#: Characters of which it is sure that any library has them as letters, figures, other signs or white space: ASCII and the
#: letters of the two Latin blocks behind it.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ſ", r"!-/:-@\[-`{-~"
#: Fixed value: what byte-level BPE parts a text by before it merges, for these characters.
_PARTS = rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|\s+(?!\S)|\s+"


#: Kinds of bytes of sure characters: letters (both bytes of those beyond ASCII), figures, other signs, space, line end; 0 is any other.
_LETTER, _FIGURE, _SIGN, _SPACE, _LINE = 1, 2, 3, 4, 5
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127] = _SIGN
_KINDS[48:58] = _FIGURE
_KINDS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER
_KINDS[[32, 10]] = _SPACE, _LINE


def _kinds(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where chunks begin and end in their bytes, these, and their kinds."""
    at = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return at - at[0], data, _KINDS[data]


def _parted(added: list[str]) -> Callable[[pa.Array], tuple[np.ndarray, pa.Array, np.ndarray]]:
    """`parted` of a ChunkTable by _PARTS, where a piece is a run of bytes of one kind, with a space before the first.

    So it is in chunks of sure characters without apostrophe, without white space beside white space, and with no space
    but the first character.
    """

    def parted(chunks: pa.Array):
        at, data, kind = _kinds(chunks)
        starts = at[:-1][at[1:] > at[:-1]]
        inner = np.ones(len(data), bool)
        inner[starts] = False
        odd = (kind == 0) | (data == ord("'")) | ((kind == _SPACE) & inner)
        white = kind >= _SPACE
        odd[1:] |= inner[1:] & ((white[1:] & white[:-1]) | ((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))))
        seen = np.append(0, np.cumsum(odd))
        done = (seen[at[1:]] == seen[at[:-1]]) & (at[1:] > at[:-1])
        for x in added:
            done &= ~pc.match_substring(chunks, x).to_numpy(zero_copy_only=False)
        if not done.any():
            return done, None, np.zeros(0, np.int64)
        at, data, kind = _kinds(chunks.filter(pa.array(done)))
        begins = np.ones(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        begins[at[:-1]] = True
        places = np.flatnonzero(begins)
        pieces = pa.StringArray.from_buffers(len(places), pa.py_buffer(np.append(places, len(data)).astype(np.int32)), pa.py_buffer(data))
        return done, pieces, np.searchsorted(places, at[:-1])

    return parted


def _byte_pieces(tokenizer) -> tuple[Callable[[str], list[str] | None], Callable[[str], bytes]] | tuple[None, None]:
    """`pieces` and `one` of a ChunkTable: parts of chunks of sure characters, merged by the library's own model.

    Pieces recur where chunks don't: a word with a comma behind it, or at the end of a line, is the word again. None for a
    tokenizer that parts texts otherwise.
    """
    way = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
    if tokenizer.normalizer or way.get("type") != "ByteLevel" or not way["use_regex"] or way["add_prefix_space"]:
        return None, None
    fits, word, parts = (re.compile(x) for x in (rf"[!-~ \n{_LETTERS}]*", f" ?[{_LETTERS}]+", _PARTS))
    added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    holds = re.compile("|".join(map(re.escape, added))).search if added else lambda chunk: None
    seen = [chr(i) for i in range(0x180) if fits.fullmatch(chr(i))]
    # The library's signs for the bytes of each character.
    signs = str.maketrans({x: "".join(y for y, _ in tokenizer.pre_tokenizer.pre_tokenize_str(x)) for x in seen})
    merge = tokenizer.model.tokenize

    def pieces(chunk: str) -> list[str] | None:
        if word.fullmatch(chunk) and not holds(chunk):
            return [chunk]
        return parts.findall(chunk) if fits.fullmatch(chunk) and not holds(chunk) else None

    return pieces, lambda piece: array("i", [x.id for x in merge(piece.translate(signs))]).tobytes()


@functools.lru_cache(1)
def byte_bpe(name: str = "byte_bpe_50k.json") -> ChunkTable:
    """Byte-level BPE: a space goes with the word behind it, so a chunk is a space and what follows."""
    t = _library(name)
    newline = t.encode("\n", add_special_tokens=False).ids

    def cut(text: str) -> list[str]:
        head, *rest = _EDGE.split(text)
        return [head, *(" " + x for x in rest)]

    plain = _plain(t, re.compile(r" ?\S+(?:\n\S+)*").fullmatch)
    pieces, one = _byte_pieces(t)
    parted = _parted([x.content for x in t.get_added_tokens_decoder().values()]) if pieces else None
    return ChunkTable(_joined(t, "\n", newline[0], plain), _loose, cut, "", pieces, one, parted)


@functools.lru_cache(1)
def word_bpe(name: str = "word_bpe_49k.json") -> ChunkTable:
    """BPE with word ends, white space dropped: any space parts two chunks."""
    t = _library(name)
    mark = t.encode("\x01", add_special_tokens=False).ids
    plain = _plain(t, re.compile("[^\x01]+").fullmatch)
    table = ChunkTable(_joined(t, " \x01 ", mark[0], plain), lambda parts, words: np.zeros(len(words), bool), lambda text: [text], " ")
    inner = table.encode
    table.encode = lambda texts: inner(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "))
    return table


@functools.lru_cache(1)
def piece_bpe(name: str = "piece_bpe_32k.model") -> tuple[ChunkTable, object]:
    """SentencePiece: spaces become markers and none of its pieces has a marker behind another character.

    Any run of markers and what follows is a chunk. Raises ValueError for a model of which this doesn't hold.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    if any(re.search("[^▁]▁", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        raise ValueError("pieces of this model cross white-space markers")
    if sp.encode(" x ") == sp.encode("x"):
        raise ValueError("this model drops white space")
    marker = sp.piece_to_id("▁")

    def segment(chunks: list[str]):
        # The library puts a marker before each text, in place of the chunk's first one.
        return _flattened([x or [marker] for x in sp.encode([c[1:] for c in chunks], num_threads=1)])

    cut = lambda text: re.findall("[ ▁]+[^ ▁]*", " " + text)
    return ChunkTable(segment, _marked, cut, " "), sp
