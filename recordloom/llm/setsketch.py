"""MinHash near-duplicates by SetSketch registers: bands of registers give candidates, a likelihood and the sets decide.

Each of M registers hashes all shingles of a set (the runs of WORDS words, see near_copies.Shingles) to an exponential
variable of rate RATE and keeps the least one, x, on a scale of powers of BASE: floor(1 - log x), cut at 0 and 65535.
Registers of two sets merge by their maxima (merge()), and are equal with a probability near the sets' Jaccard similarity:
0.8513 where it is 0.85, and at least so for more. Sets with BAND equal registers in a row at a fixed place are candidates
(linking.linked); with BANDS such places a pair of just 0.85 is missed by all of them once in 170 million, and one of 0.9
once in 10 to the 12. Of a candidate, the numbers of registers that are greater, less and equal, and both sets' exact sizes,
give the likelihood of each similarity; where the best one is more likely than all from the threshold on by a ratio that
DOUBT bounds (a chance of 10 to the -8), the pair goes no further, nor where parities of the sets over 1024 bits show that
they share too little. All others are held against each other by their whole sets, so no link is wrong. Equal sets are one
row of the search.

Cases: a text without words, or null, has the empty set and is linked with nothing, not even with another such text; a
shorter text than WORDS words is one shingle; equal rows, rows with the same id or without one are rows of their own; a
group's component_id is its smallest id that isn't null, null where it has none, and kept then is true for all of its
rows without one; a very long text has one sketch of all of it; an empty table gives an empty one; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, utf8, written
from .components import hot_lookup
from .linking import linked
from .near_copies import Shingles, _place, _placed, _verified

#: Words of a shingle, least similarity of a link.
WORDS, SIMILARITY = 5, Fraction(85, 100)
#: Registers of a band, bands, registers; base of the scale and rate of the variables.
BAND, BANDS = 5, 32
M, BASE, RATE = BAND * BANDS, 1.02, 20.0
#: Twice the logarithm of the ratio of likelihoods from which a pair is given up.
DOUBT = 32.0
#: Shingles that are hashed at once.
_STEP = 1024

_SEEDS = np.frombuffer(b"".join(xxhash.xxh3_64_digest(b"register", i) for i in range(M)), np.uint32).reshape(M, 2).copy()
_ODD, _ADD = _SEEDS[:, :1] | np.uint32(1), _SEEDS[:, 1:]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The M registers of a set of 64-bit hashes; all 0 for the empty one."""
    least = np.full(M, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(hashes), _STEP):
        own = hashes[a : a + _STEP]
        low, high = own.astype(np.uint32), (own >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, (low * _ODD + (high ^ _ADD)).min(1), out=least)
    x = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16) if len(hashes) else np.zeros(M, np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def _log_likelihood(j, u, more, less, same):
    """Of similarity j, with the sizes' share u; see Ertl, SetSketch (2021): chances of a greater and of a lesser register."""
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    greater, smaller = p(u - (1 - u) * j), p(1 - u - u * j)
    return more * np.log(greater) + less * np.log(smaller) + same * np.log(np.maximum(1 - greater - smaller, 1e-12))


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of sets with registers a and b (a row each) and sizes n and m, and twice the log of the ratio of their
    likelihoods to those of the best similarity from the threshold on; infinite where the sizes allow none.
    """
    n, m = n.astype(float), m.astype(float)
    most, u = np.minimum(n, m) / np.maximum(n, m), n / (n + m)
    more, less, same = ((x).sum(-1) for x in (a > b, a < b, a == b))
    at = lambda j: _log_likelihood(j, u, more, less, same)
    low, high = np.zeros(len(most)), most.copy()
    for _ in range(40):  # the likelihood has one peak
        third = (high - low) / 3
        left = at(low + third) < at(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    best = (low + high) / 2
    ratio = np.where(most < threshold, np.inf, 2 * (at(best) - at(np.minimum(np.maximum(best, threshold), most))))
    return best, ratio


def _possible(similarity: Fraction):
    """For linked(): the place is a band; a pair counts in its first equal band only. A sketch ends with size (8 bytes) and parities.

    The parities of two sets over 1024 bits differ in no more bits than the sets in shingles, which bounds what they share.
    """
    num, den = similarity.numerator, similarity.denominator
    t = float(similarity)
    p = np.log1p(t * (BASE - 1)) / np.log(BASE)
    few = int(M * p - 7 * np.sqrt(M * p * (1 - p)))  # equal registers that a similar pair has, but for a chance of 1e-11

    def possible(place, one, places, others):
        a, b = one[: 2 * M].view(np.uint16), np.ascontiguousarray(others[:, : 2 * M]).view(np.uint16)
        equal = b == a
        able = np.flatnonzero((equal.sum(1) >= few) & ~equal[:, : BAND * place].reshape(len(b), place, BAND).all(2).any(1))
        if len(able):
            n, m = one[2 * M : 2 * M + 8].view(np.int64), np.ascontiguousarray(others[able, 2 * M : 2 * M + 8]).view(np.int64)[:, 0]
            apart = np.bitwise_count(np.ascontiguousarray(others[able, 2 * M + 8 :]).view(np.uint64) ^ one[2 * M + 8 :].view(np.uint64)).sum(1, dtype=np.int64)
            likely = estimate(a[None, :], b[able], np.broadcast_to(n, m.shape), m, t)[1] <= DOUBT
            able = able[likely & ((n + m - apart) * (num + den) >= 2 * num * (n + m))]
        out = np.zeros(len(b), bool)
        out[able] = True
        return out

    return possible


def _described(rows: DataFrame, words: int) -> DataFrame:
    """id, file and at of each row; set (its digest), n (its size), parity over 1024 bits and sketch (registers, size, parity)."""

    def run(batches):
        of = Shingles(words)
        for batch in text_slices(batches, 3):
            digests, sizes, parities, sketches = [], [], [], []
            for raw in utf8(batch.column(3)):
                h = of(raw)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                parities.append(np.packbits((np.bincount((h >> np.uint64(54)).astype(np.int64), minlength=1024) & 1).astype(bool)).tobytes())
                sketches.append(sketch(h).tobytes() + len(h).to_bytes(8, "little") + parities[-1])
            columns = [*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(parities, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "file", "at", "set", "n", "parity", "sketch"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "file", "at", "text").mapInArrow(run, f"id {kind}, file bigint, at bigint, set binary, n bigint, parity binary, sketch binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of its group) and kept (whether that is its own) of each row."""
    docs = _placed(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *_place(docs))
    own = written(_described(rows, words).select(F.monotonically_increasing_id().alias("row"), "*"), "sketches")
    best = own.where("n > 0").groupBy("set").agg(F.min(F.struct("row", "file", "at", "n", "parity", "sketch")).alias("x"), F.min("id").alias("low"), F.count("*").alias("copies"))
    nodes = written(best.select("set", "low", "copies", "x.*"), "nodes")
    bands = F.array(*(F.xxhash64(F.lit(k), F.substring("sketch", 1 + 2 * BAND * k, 2 * BAND)) for k in range(BANDS)))
    entries = nodes.select("row", F.posexplode(bands).alias("place", "h")).select("h", "row", F.col("place").cast("bigint").alias("place"))
    verify = lambda pairs: _verified(pairs, rows.select("file", "at", "text"), nodes.select("row", "file", "at", "n", "parity"), words, similarity)
    met = linked(entries, nodes.select("row", "sketch"), _possible(similarity), verify).withColumnRenamed("node", "row")
    joined = written(nodes.select("set", "low", "copies", "row").join(met, "row", "left").select("set", "low", "copies", F.coalesce("component", "row").alias("component")), "joined")
    least = joined.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("sets"))
    table = hot_lookup(joined, written(least, "least"), "component", "sets").select("set", "component_id", "copies")
    out = hot_lookup(own.where("n > 0").select("id", "n", "set"), written(table, "groups"), "set", "copies")
    alone = own.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = out.select("id", "n", "component_id").unionByName(alone)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
