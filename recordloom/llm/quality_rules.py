"""Quality rules as a short-circuit cascade.

Each document has a small record of measures taken from its whole text; a rule rejects by measures. On a bounded sample
of whole texts the time of every measure and the verdict of every rule are noted, and the rules are ordered greedily:
next comes the rule that rejects the most of the texts still left for the time that it adds, which is that of the
measures that no rule before it has taken. A document leaves the cascade at the first rule that rejects it, so measures
that only later rules need are never taken for it. The verdict is the same in any order; only the work differs.

Cases: a null text has no words and is an empty one; a row is judged by its text alone, so repeated rows have equal
results; a text of any length is measured whole, one batch at a time; of rules that are equal in rejection for their
cost, the cheaper and then the earlier one goes first; an empty table gives an empty one; other columns of the input,
whatever their names, are ignored by judge() and kept by keep().
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, id_and_text, text_slices, utf8

#: Documents at most on which cost and selectivity are estimated.
SAMPLE = 1000
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))


class Measures:
    """What rules ask of a text; each measure is taken when it is first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self._words = self._repeat = self._lines = self._top = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()  # at bytes 0x20 and 0x09 to 0x0D
        return self._words

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_bytes(self) -> int:
        return len(self.raw.translate(None, _SPACE))

    @property
    def word_chars(self) -> int:
        """Code points in words: their bytes that don't continue a character."""
        return len(self.raw.translate(None, _SPACE + bytes(range(128, 192))))

    @property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    @property
    def n_capitals(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _CAPITALS))

    @property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and how many of them equal an earlier one."""
        if self._lines is None:
            own = [x for x in self.raw.split(b"\n") if x and not x.isspace()]
            self._lines = len(own), len(own) - len(set(own))
        return self._lines

    @property
    def n_dup_lines(self) -> int:
        return self.lines[1]

    @property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that the text has twice or more."""
        if self._repeat is None:
            number: dict[bytes, int] = {}
            at = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, len(self.words))
            self._top = int(np.bincount(at).max()) if len(at) else 0
            if len(at) < 4 or len(number) == len(at):
                self._repeat = 0
            else:
                pair = np.unique(at[:-1] * len(number) + at[1:], return_inverse=True)[1]
                _, window, times = np.unique(pair[:-1] * len(number) + at[2:], return_inverse=True, return_counts=True)
                twice = times[window] > 1
                within = np.zeros(len(at), bool)
                for k in range(3):
                    within[k : len(at) - 2 + k] |= twice
                self._repeat = int(within.sum())
        return self._repeat

    @property
    def top_word(self) -> int:
        """How often the most frequent word occurs."""
        self.n_repeat_words  # noqa: B018  numbers the words
        return self._top


@dataclass(frozen=True)
class Rule:
    """needs: the measures that rejects() asks for, in the order in which it does."""

    name: str
    rejects: Callable[[Measures], bool]
    needs: tuple[str, ...] = ()


#: The two of the contract, and those of the method.
BASE = (
    Rule("few_words", lambda m: m.n_words < 50, ("words",)),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 50 * m.n_words, ("words", "n_repeat_words")),
)
RULES = (
    Rule("symbols", lambda m: 20 * m.n_symbols > m.n_words, ("words", "n_symbols")),
    Rule("duplicate_lines", lambda m: m.lines[0] >= 4 and 2 * m.lines[1] > m.lines[0], ("lines",)),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 14 * m.n_words, ("words", "word_chars")),
    Rule("shouting", lambda m: 5 * m.n_capitals > 2 * m.word_chars, ("n_capitals", "word_chars")),
    Rule("top_word", lambda m: m.n_words >= 20 and 4 * m.top_word > m.n_words, ("words", "n_repeat_words", "top_word")),
)
#: What judge() returns of every text, and so takes before the first rule.
TOLD = ("words", "word_chars", "n_symbols", "lines", "n_repeat_words")


def observed(docs: DataFrame, rules: Sequence[Rule], sample: int = SAMPLE, text_col: str = "text") -> list[tuple[list[float], list[float], list[bool]]]:
    """For each sampled text: the seconds of each measure (as in measures_of()), and of each rule besides, and the verdicts.

    The first rows of partitions all over the table are the sample, so little more than they is read; tasks measure
    them, and only numbers come to the driver. Each partition has an equal share of `sample`, down to none.
    """
    parts, names = max(1, docs.rdd.getNumPartitions()), measures_of(rules)

    def run(batches):
        k = TaskContext.get().partitionId()
        left = (k + 1) * sample // parts - k * sample // parts
        if not left:
            return
        for batch in text_slices(batches, 0):
            for raw in utf8(batch.column(0))[:left]:
                m, times, own, verdicts = Measures(raw), [], [], []
                for n in names:
                    began = time.perf_counter()
                    getattr(m, n)
                    times.append(time.perf_counter() - began)
                for rule in rules:
                    began = time.perf_counter()
                    verdicts.append(bool(rule.rejects(m)))
                    own.append(time.perf_counter() - began)
                left -= 1
                yield pa.RecordBatch.from_arrays([pa.array([times], pa.list_(pa.float64())), pa.array([own], pa.list_(pa.float64())), pa.array([verdicts], pa.list_(pa.bool_()))], ["times", "own", "verdicts"])
            if not left:
                return

    found = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "times array<double>, own array<double>, verdicts array<boolean>")
    return [(r["times"], r["own"], r["verdicts"]) for r in found.collect()]


def measures_of(rules: Sequence[Rule]) -> list[str]:
    """The measures that these rules need, each behind those that it rests on."""
    return list(dict.fromkeys(n for rule in rules for n in rule.needs))


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE, text_col: str = "text", taken: Sequence[str] = (), before: Sequence[Rule] = ()) -> list[dict]:
    """The rules in their order, each with cost (seconds that it adds for a text) and rejected (share), of the texts left.

    taken: measures that are there anyway; before: rules that texts have passed already.
    """
    seen, names = observed(docs, [*before, *rules], sample, text_col), measures_of([*before, *rules])
    times, own, hits = (np.array([x[k] for x in seen], float).reshape(len(seen), n) for k, n in ((0, len(names)), (1, len(before) + len(rules)), (2, len(before) + len(rules))))
    left = ~(hits[:, : len(before)] > 0).any(1)
    have, todo, out = set(taken) | {n for rule in before for n in rule.needs}, list(range(len(rules))), []
    while todo:
        options = []
        for i in todo:
            k = len(before) + i
            cost = own[left, k] + times[left][:, [j for j, n in enumerate(names) if n in rules[i].needs and n not in have]].sum(1)
            # With nothing left, the order no longer matters.
            cost, rejected = (float(cost.mean()), float(hits[left, k].mean())) if left.any() else (0.0, 0.0)
            options.append({"rule": i, "name": rules[i].name, "cost": cost, "rejected": rejected})
        best = min(options, key=lambda x: (-x["rejected"] / max(x["cost"], 1e-9), x["cost"], x["rule"]))
        out.append(best)
        todo.remove(best["rule"])
        have |= set(rules[best["rule"]].needs)
        left &= hits[:, len(before) + best["rule"]] == 0
    return out


def _kept(m: Measures, order: list[Rule]) -> bool:
    return not any(rule.rejects(m) for rule in order)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base measures, base_failed and kept of each row."""
    order = [rules[x["rule"]] for x in plan(docs, rules, sample, text_col, TOLD, BASE)]
    df = id_and_text(docs, id_col, text_col)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in text_slices(batches):
            rows = []
            for raw in utf8(batch.column(1)):
                m = Measures(raw)
                failed = any(rule.rejects(m) for rule in BASE)
                rows.append((*(getattr(m, c) for c in longs), failed, not failed and _kept(m, order)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in columns[:5]), *(pa.array(x, pa.bool_()) for x in columns[5:])], ["doc_id", *longs, "base_failed", "kept"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in longs)}, base_failed boolean, kept boolean")


def keep(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *RULES), sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """The rows whose texts no rule rejects, the base rules among them, with all their columns."""
    order = [rules[x["rule"]] for x in plan(docs, rules, sample, text_col)]
    return filtered(docs, text_col, lambda: lambda texts: [_kept(Measures(raw), order) for raw in utf8(texts)])


#: The same rows in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, t, ws, ls, len(ws) AS n, list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS gs FROM w),
r AS (SELECT doc_id, unnest(gs) AS s, generate_subscripts(gs, 1) AS p FROM g),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM r) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
top AS (SELECT doc_id, max(c) AS top_word FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS x FROM w) GROUP BY doc_id, x) GROUP BY doc_id),
m AS (SELECT g.doc_id, n AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(n_repeat, 0) AS n_repeat_words, coalesce(top_word, 0) AS top_word
  FROM g LEFT JOIN cov USING (doc_id) LEFT JOIN top USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 20 * n_symbols > n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
    OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 5 * n_capitals > 2 * word_chars OR (n_words >= 20 AND 4 * top_word > n_words)) AS kept
FROM m
"""
