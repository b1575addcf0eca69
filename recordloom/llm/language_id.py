"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary; each language has a probability for every piece. The probability of
a word in a language is summed over all its segmentations into pieces by a forward algorithm, and a text's score is the
sum of its words' logarithms. Piece probabilities are learned by expectation maximisation over the words of labelled
texts: words are counted by language over the whole corpus, and each distinct word is worked on once in each round.

A word is a run of letters, in lower case, behind a word marker. A run of more than LONGEST letters is a chain of parts of
LONGEST letters, of which only the first has the marker; no piece crosses the end of a part. A letter that is no piece
is an unknown piece. Arrays over words of one length hold the sums of all of them at once and are scaled every SCALED
letters, so that no sum is lost below the smallest number; substrings are told by 64-bit hashes. A Python worker keeps
the scores of words from text to text, in a bounded table.

Cases: a null text, or one without a letter, has lang_pred `und` and score 0; so have all if no row can be learned
from; equal scores go to the first language by name; rows with null lang or doc_id aren't learned from; repeated rows
count each; a text of any length is scored whole, in a batch of its own; an empty table gives an empty one; other
columns, whatever their names, are ignored by predict() and kept by keep().
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_table import tokenizer_path
from .common import filtered, id_and_text, text_slices, written

VOCABULARY = "piece_bpe_32k.model"
#: Letters of a part, rounds of expectation maximisation, letters between scalings.
LONGEST, ROUNDS, SCALED = 256, 2, 8
#: How far a language's distribution is drawn to that of all of them, and that one to an even one: shares of all counts.
POOLED, EVEN = 0.001, 0.01
#: Words that a task counts before it sends its counts on; words whose scores a worker keeps, in two halves.
HELD, REMEMBERED = 150_000, 150_000
#: keep() takes a text for none of the languages that lies so many standard deviations of a word below the usual; the least
#: deviation that counts (a few memorised words have hardly any).
FAR, SPREAD = 5.0, 0.7
_WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"


def words(text: str) -> list[str]:
    """The marked words of a text; of a long run, its parts."""
    own = _WORD.findall(text.lower())
    if max(map(len, own), default=0) > LONGEST:
        own = [(MARK if i == 0 else "") + w[i : i + LONGEST] for w in own for i in range(0, len(w), LONGEST)]
        return own
    return [MARK + w for w in own]


def has_letter(own: list[str]) -> bool:
    return any(c.isalpha() for w in own for c in w.lstrip(MARK))


def vocabulary(name: str = VOCABULARY) -> dict[str, int]:
    """The pieces that a marked word in lower case can be made of; 0 is the unknown one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    own = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return {p: i + 1 for i, p in enumerate(sorted({p for p in own if p == p.lower() and re.fullmatch(r"▁?[^\W\d_]*", p) and p}))}


_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Pieces and their beginnings as sorted 64-bit hashes, so that whole columns of substrings are looked up at once."""

    def __init__(self, ids: dict[str, int]):
        self.longest = max(map(len, ids), default=1)
        own = dict.fromkeys((p[:k] for p in ids for k in range(1, len(p) + 1)), -1) | ids
        size = self.longest
        codes = np.zeros((len(own), size), np.uint64)
        n = np.fromiter(map(len, own), np.int64, len(own))
        for row, p in enumerate(own):
            codes[row, : len(p)] = [ord(c) for c in p]
        h = np.zeros(len(own), np.uint64)
        for k in range(size):
            h = np.where(k < n, self.next(h, codes[:, k]), h)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.fromiter(own.values(), np.int32, len(own))[order]

    @staticmethod
    def next(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The hash of a text with one more letter."""
        return (h + code + np.uint64(1)) * _BASE

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece, -1 for the beginning of one, -2 for neither."""
        if not len(self.hashes):
            return np.full(len(h), -2, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], np.int32(-2))


class Lattices:
    """Segmentations of words of one length: for two places, the rows of words with a piece between them, and the pieces."""

    def __init__(self, own: list[str], pieces: Pieces):
        codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), -1).astype(np.uint64)
        (self.rows, self.n), self.longest = codes.shape, pieces.longest
        self.spans: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for i in range(self.n):
            alive, h = np.arange(self.rows), np.zeros(self.rows, np.uint64)
            for j in range(i + 1, min(self.n, i + pieces.longest) + 1):
                h = pieces.next(h, codes[alive, j - 1])
                found = pieces.find(h)
                if j == i + 1:  # one letter always is a piece, if only the unknown one
                    self.spans.append((i, j, alive, np.maximum(found, 0)))
                elif len(hit := np.flatnonzero(found >= 0)):
                    self.spans.append((i, j, alive[hit], found[hit]))
                on = found > -2
                alive, h = alive[on], h[on]
                if not len(alive):
                    break

    def forward(self, of, shape: tuple = ()) -> tuple[list[np.ndarray], list[np.ndarray | float]]:
        """For each place, the summed probability of all ways to it, and the logarithm by which that is to be raised.

        of(ids, rows) gives probabilities, `shape` for each word.
        """
        at, log = [np.zeros((self.rows, *shape)) for _ in range(self.n + 1)], [0.0] * (self.n + 1)
        at[0] += 1
        reached = 0
        for i, j, rows, ids in self.spans:
            if i != reached:
                reached = i
                if i % SCALED == 0:  # all ways to place i are summed; it becomes 1
                    by = at[i].copy()
                    for k in range(i, min(self.n, i + self.longest) + 1):
                        at[k] /= by
                    log[i:] = [log[i] + np.log(by)] * (self.n + 1 - i)
            at[j][rows] += at[i][rows] * of(ids, rows)
        return at, log

    def logs(self, of, shape: tuple = ()) -> np.ndarray:
        """The logarithm of each word's probability."""
        at, log = self.forward(of, shape)
        return np.log(at[-1]) + log[-1]

    def expected(self, of, times: np.ndarray, add) -> None:
        """add(ids, rows, numbers): each piece's expected number in each word, times the word's count."""
        ahead, log = self.forward(of)
        back, later = [np.zeros(self.rows) for _ in ahead], [0.0] * (self.n + 1)
        back[self.n] += 1
        reached = self.n
        for i, j, rows, ids in sorted(self.spans, key=lambda x: -x[1]):
            if j != reached:
                reached = j
                if j % SCALED == 0:
                    by = back[j].copy()
                    for k in range(max(0, j - self.longest), j + 1):
                        back[k] /= by
                    later[: j + 1] = [later[j] + np.log(by)] * (j + 1)
            back[i][rows] += of(ids, rows) * back[j][rows]
        whole = log[self.n] + np.log(ahead[self.n])
        for i, j, rows, ids in self.spans:
            scale = times * np.exp(log[i] + later[j] - whole)
            add(ids, rows, ahead[i][rows] * of(ids, rows) * back[j][rows] * scale[rows])


def by_length(own: list[str]) -> dict[int, list[int]]:
    groups = defaultdict(list)
    for i, w in enumerate(own):
        groups[len(w)].append(i)
    return groups


@dataclass
class Model:
    """langs in order, and p: pieces x langs, the unknown piece first.

    usual: for each language, mean and standard deviation of a word's logarithm for each of its letters, in what was learned.
    """

    langs: list[str]
    p: np.ndarray
    pieces: Pieces
    usual: np.ndarray | None = None

    def logs(self, own: list[str], letters: int = 200_000) -> np.ndarray:
        """words x langs: the logarithm of each word's probability. letters: how many are worked on at once, about."""
        out = np.zeros((len(own), len(self.langs)))
        for size, rows in by_length(own).items():
            most = max(1, letters // size)
            for a in range(0, len(rows), most):
                part = rows[a : a + most]
                out[part] = Lattices([own[i] for i in part], self.pieces).logs(lambda ids, _: self.p[ids], (len(self.langs),))
        return out


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Probabilities from counts (pieces x langs), drawn to those of all languages together and these to even ones.

    Both by a share, so that what isn't seen doesn't grow less likely as more is learned.
    """
    pooled = (1 - EVEN) * counts.sum(1) / counts.sum() + EVEN / len(counts)
    total = counts.sum(0)
    own = np.where(total > 0, counts / np.where(total > 0, total, 1), pooled[:, None])
    return (1 - POOLED) * own + POOLED * pooled[:, None]


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all rows of docs (lang, text)."""

    def run(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def counts():
            while held:
                lang, own = held.popitem()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["lang", "word", "n"])

        for batch in text_slices(batches):
            for lang, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                held[lang].update(words(text))
                if sum(map(len, held.values())) > HELD:
                    yield from counts()
        yield from counts()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", name: str = VOCABULARY, rounds: int = ROUNDS, usual: bool = True) -> Model:
    """The model of all rows of docs whose lang and text aren't null; usual: with what keep() needs, one more pass over words."""
    known = vocabulary(name)
    pieces, n = Pieces(known), len(known) + 1
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null")
    counted = written(word_counts(rows), "words")
    # As many rows as there are languages.
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    if not langs:
        return Model([], np.zeros((n, 0)), pieces)
    at = {lang: k for k, lang in enumerate(langs)}

    def expect(p: np.ndarray) -> np.ndarray:
        broadcast = docs.sparkSession.sparkContext.broadcast((p, pieces))

        def run(batches):
            (p, pieces), out = broadcast.value, np.zeros((n, len(langs)))
            for batch in batches:
                own, lang, times = batch.column(1).to_pylist(), np.array([at[x] for x in batch.column(0).to_pylist()]), batch.column(2).to_numpy().astype(float)
                for part in by_length(own).values():
                    mine = lang[part]
                    Lattices([own[i] for i in part], pieces).expected(lambda ids, rows, mine=mine: p[ids, mine[rows]], times[part], lambda ids, rows, x, mine=mine: np.add.at(out, (ids, mine[rows]), x))
            piece, lang = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(out[piece, lang])], ["piece", "lang", "n"])

        # Pieces times languages at most.
        sums = counted.select("lang", "word", "n").mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros((n, len(langs)))
        # Rounded, so that the order in which tasks end leaves no trace.
        out[sums["piece"].to_numpy(), sums["lang"].to_numpy()] = np.round(sums["n"].to_numpy(), 6)
        broadcast.unpersist()
        return _smoothed(out)

    p = np.full((n, len(langs)), 0.125)  # first, every piece wherever it fits
    for _ in range(1 + rounds):
        p = expect(p)
    return Model(langs, p, pieces, _usual(counted, at, p, pieces) if usual else None)


def _usual(counted: DataFrame, at: dict[str, int], p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """langs x (mean, standard deviation) of the logarithms of counted words in their languages, for each letter."""
    broadcast = counted.sparkSession.sparkContext.broadcast((p, pieces))

    def run(batches):
        (p, pieces), sums = broadcast.value, np.zeros((len(at), 3))
        for batch in batches:
            own, lang, times = batch.column(1).to_pylist(), np.array([at[x] for x in batch.column(0).to_pylist()]), batch.column(2).to_numpy().astype(float)
            for size, part in by_length(own).items():
                mine = lang[part]
                each = Lattices([own[i] for i in part], pieces).logs(lambda ids, rows, mine=mine: p[ids, mine[rows]]) / size
                for k, v in enumerate((np.ones(len(part)), each, each * each)):
                    np.add.at(sums[:, k], mine, v * times[part])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), *(pa.array(sums[:, k]) for k in range(3))], ["lang", "n", "s", "q"])

    # A row for each language.
    rows = counted.select("lang", "word", "n").mapInArrow(run, "lang int, n double, s double, q double").groupBy("lang").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    broadcast.unpersist()
    out = np.zeros((len(at), 2))
    for r in rows:
        mean = r["s"] / max(r["n"], 1)
        out[r["lang"]] = round(mean, 6), round(max(r["q"] / max(r["n"], 1) - mean * mean, 0) ** 0.5, 6)
    return out


class _Scores:
    """The logarithms of words that a worker has met, in a bounded table: what hasn't been met for long is worked out again."""

    def __init__(self, model: Model):
        self.model, self.known, self.older = model, {}, {}

    def __call__(self, own: list[str]) -> np.ndarray:
        rows = list(map(self.known.get, own))
        for i in [i for i, x in enumerate(rows) if x is None]:
            if (row := self.older.get(own[i])) is not None:
                self.known[own[i]] = rows[i] = row
        new = [i for i, x in enumerate(rows) if x is None]
        if new:
            for i, row in zip(new, self.model.logs([own[i] for i in new]), strict=True):
                rows[i] = raw = row.tobytes()
                if len(own[i]) <= 32:
                    if len(self.known) >= REMEMBERED // 2:
                        self.known, self.older = {}, self.known
                    self.known[own[i]] = raw
        return np.frombuffer(b"".join(rows), np.float64).reshape(len(own), len(self.model.langs))


def _judge(scores: _Scores, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score, and how far the text's words lie from the usual of that language, in a word's standard deviations.

    With fewer than 16 words, the last is less in proportion to its error.
    """
    number, model = defaultdict(itertools.count().__next__), scores.model
    langs, score, beyond = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    place, seq = [], []
    for i, text in enumerate(texts):
        own = words(text) if text and model.langs else []
        if own and has_letter(own):
            place.append(i)
            seq.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
    if place:
        logs = scores(list(number))
        size = np.fromiter(map(len, number), np.int64, len(number))
        for i, own in zip(place, seq, strict=True):
            total = logs[own].sum(0)
            k = int(total.argmax())
            langs[i], score[i] = model.langs[k], 1 / np.exp(total - total[k]).sum()
            mean, spread = model.usual[k] if model.usual is not None else (0.0, np.inf)
            beyond[i] = ((logs[own, k] / size[own]).mean() - mean) / max(spread, SPREAD) * min(1, len(own) ** 0.5 / 4)
    return langs, score, beyond


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the language's probability among all, each as likely beforehand) of each row."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scores = _Scores(broadcast.value)
        for batch in text_slices(batches):
            langs, score, _ = _judge(scores, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    df = id_and_text(docs, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5, far: float = FAR, text_col: str = "text") -> DataFrame:
    """The rows whose language is known, with all their columns: those with a letter, a score of `least` or more, and words
    that lie no more than `far` below the usual of their language, so that a text in none of them goes.

    Where no language could be learned, all rows with a letter are kept.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def passing():
        scores = _Scores(broadcast.value)

        def passes(texts: pa.Array) -> list[bool]:
            own = texts.to_pylist()
            if not scores.model.langs:
                return [has_letter(words(x or "")) for x in own]
            return [x != "und" and s >= least and b >= -far for x, s, b in zip(*_judge(scores, own), strict=True)]

        return passes

    return filtered(docs, text_col, passing)
