"""URL filter: rules by host and path, and a ratio of two character language models for all other URLs.

The URLs that an allow rule fits are the accepted ones, those of a block rule the rejected ones. Four of five (by a
hash of the URL) train two Markov models of characters, of orders 0 to ORDER, each order drawn to the next lower one by
as much as its context has different followers (Witten and Bell). The difference of the two log-likelihoods divided by
the length is the score; the fifth calibrates it: the threshold is where the two shares of right verdicts add up to
most. URLs that no rule fits are blocked below it.

A URL is modelled from behind `://`, over an alphabet of SYMBOLS letters, so that counts and the table of differences,
which is broadcast, have SYMBOLS ** (ORDER + 1) cells at most, however many URLs there are.

Cases: a null URL, or one without `://`, has an empty host and path, fits no rule, and is judged as an empty text; if
either kind of URL is lacking, nothing else is blocked; equal URLs have equal results; an empty table gives an empty
one; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
_KNOWN = b".:/-_?=&#%~+"
#: a-z, digits as one, _KNOWN, any other byte, start and end.
SYMBOLS, START, STOP, ORDER = 26 + 1 + len(_KNOWN) + 1 + 2, 26 + 1 + len(_KNOWN) + 1, 26 + 1 + len(_KNOWN) + 2, 3
_TABLE = np.full(256, 27 + len(_KNOWN), np.int64)
_TABLE[97:123] = _TABLE[65:91] = np.arange(26)
_TABLE[48:58] = 26
_TABLE[list(_KNOWN)] = np.arange(27, 27 + len(_KNOWN))
#: Scores are counted in steps of 1 / STEPS between -EDGE and EDGE for the threshold.
STEPS, EDGE = 64, 16


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ORDER + 1 symbols of each URL from behind `://`, as numbers, and how many each has."""
    own = [u.partition(b"://")[2] for u in urls]
    n = np.fromiter(map(len, own), np.int64, len(own)) + 1
    ends = np.cumsum(n + ORDER)
    symbols = np.full(int(ends[-1]) if len(ends) else 0, START, np.int64)
    body = np.ones(len(symbols), bool)
    for k in range(1, ORDER + 1):
        body[ends - (n + ORDER) + k - 1] = False
    body[ends - 1] = False
    symbols[body] = _TABLE[np.frombuffer(b"".join(own), np.uint8)]
    symbols[ends - 1] = STOP
    if not len(symbols):
        return symbols, n
    code = np.zeros(len(symbols) - ORDER, np.int64)
    for k in range(ORDER + 1):
        code = code * SYMBOLS + symbols[k : len(symbols) - ORDER + k]
    real = np.ones(len(code), bool)
    for k in range(1, ORDER + 1):
        real[(ends - k)[ends - k < len(code)]] = False
    return code[real], n


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """For each run of symbols, the logarithm of its last one's probability behind the others; counts are of runs."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        own = counts.reshape(-1, SYMBOLS ** (order + 1)).sum(0).reshape(-1, SYMBOLS).astype(float)
        total, kinds = own.sum(1, keepdims=True), np.maximum((own > 0).sum(1, keepdims=True), 1)
        lower = p if order == 0 else np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS, 1))
        p = ((own + kinds * lower) / (total + kinds)).reshape(-1)
    return np.log(p)


@dataclass
class Model:
    """difference: accepted minus rejected log-probability of each run of symbols; None if a kind of URL is lacking."""

    difference: np.ndarray | None
    threshold: float

    def scores(self, urls: list[bytes]) -> np.ndarray:
        if self.difference is None or not urls:
            return np.zeros(len(urls))
        code, n = grams(urls)
        return np.add.reduceat(self.difference[code].astype(float), np.cumsum(n) - n) / n


def _bytes(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def train(urls: DataFrame) -> Model:
    """The model of urls (url, verdict: allow or block)."""
    fold = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5))
    cells = SYMBOLS ** (ORDER + 1)

    def count(batches):
        total = np.zeros((2, cells), np.int64)
        for batch in text_slices(batches, 0):
            blocked = pc.equal(batch.column(1), "block").to_numpy(zero_copy_only=False)
            code, n = grams(_bytes(batch.column(0)))
            np.add.at(total, (np.repeat(blocked, n).astype(np.int64), code), 1)
        kind, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(code, pa.int32()), pa.array(total[kind, code])], ["kind", "code", "n"])

    # Two rows for each cell at most.
    sums = urls.where(fold != 0).select("url", "verdict").mapInArrow(count, "kind int, code int, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, cells), np.int64)
    counts[sums["kind"].to_numpy(), sums["code"].to_numpy()] = sums["n"].to_numpy()
    if not counts.any(axis=1).all():
        return Model(None, 0.0)
    model = Model((log_probabilities(counts[0]) - log_probabilities(counts[1])).astype(np.float32), 0.0)
    broadcast = urls.sparkSession.sparkContext.broadcast(model)

    def histogram(batches):
        total = np.zeros((2, 2 * STEPS * EDGE + 1), np.int64)
        for batch in text_slices(batches, 0):
            blocked = pc.equal(batch.column(1), "block").to_numpy(zero_copy_only=False)
            step = np.clip(np.floor(broadcast.value.scores(_bytes(batch.column(0))) * STEPS).astype(np.int64), -STEPS * EDGE, STEPS * EDGE) + STEPS * EDGE
            np.add.at(total, (blocked.astype(np.int64), step), 1)
        kind, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(step, pa.int32()), pa.array(total[kind, step])], ["kind", "step", "n"])

    seen = urls.where(fold == 0).select("url", "verdict").mapInArrow(histogram, "kind int, step int, n bigint").groupBy("kind", "step").agg(F.sum("n").alias("n")).collect()
    steps = np.zeros((2, 2 * STEPS * EDGE + 1))
    for r in seen:
        steps[r["kind"], r["step"]] = r["n"]
    if not steps.any(axis=1).all():
        return model
    # Blocked below step k: the share of rejected ones below, and of accepted ones at or above.
    right = np.cumsum(steps[1]) / steps[1].sum() - np.cumsum(steps[0]) / steps[0].sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    k = best[np.abs(best + 1 - STEPS * EDGE).argmin()]
    model.threshold = (int(k) + 1 - STEPS * EDGE) / STEPS
    return model


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, score (null where a rule fits) and verdict of each row."""
    df = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    df = df.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.select("*", rule.alias("rule"), verdict.alias("verdict"))
    broadcast = pages.sparkSession.sparkContext.broadcast(train(df.where("verdict is not null").select("url", "verdict")))

    def run(batches):
        model = broadcast.value
        for batch in text_slices(batches):
            ruled = pc.is_valid(batch.column("verdict")).to_numpy(zero_copy_only=False)
            score = model.scores(_bytes(batch.column("url")))
            verdict = pc.coalesce(batch.column("verdict"), pa.array(np.where(score < model.threshold, "block", "allow").tolist(), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), batch.column("rule"), pa.array(score, mask=ruled), verdict], ["page_id", "host", "path", "rule", "score", "verdict"])

    return df.mapInArrow(run, f"page_id {df.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, score double, verdict string")
