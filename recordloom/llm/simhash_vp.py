"""SimHash near-duplicates, found in shards of a vantage-point tree over fingerprints.

A bounded sample of distinct fingerprints, one in 16 or fewer, makes the tree: a node keeps a vantage point v and a radius m.
A fingerprint at distance d from v goes inside if d <= m and outside otherwise. Two fingerprints at most 2 * REACH bits
apart have one halfway that is within REACH bits of both; so each goes to every shard that its ball of radius REACH
meets (by the triangle bound: inside if d - REACH <= m, outside if d + REACH > m), and any two to be linked meet in the
shard of the one halfway. Only those near a boundary go to several shards; see _split() for the choice of m.

A shard is searched by a task with a tree of its own, and exactly: below LEAF fingerprints all are compared in blocks;
where splitting no longer parts them (a dense cluster), they are met by their neighbours at REACH bits, 65 keys for
each, of which a key can have 65 fingerprints at most. A shard returns a spanning forest of its links, never all pairs.
Shards are large (SHARD), since copies within a task cost less than those that are shuffled; of random fingerprints,
which have no clusters, some K ** 0.23 copies go to K shards. A shard over SHARD_MOST is a dense cluster as a whole, or one
of more than SHARD times the sample's size; it is dealt by those 65 keys over all tasks.

Cases: a null or empty text has fingerprint zero, linked like any other; a bit that is set in just half of the hashes
isn't set; equal texts share a fingerprint, are one row of the search, and meet again by a join; a very long text has one
fingerprint of all of it; rows with a null doc_id belong to their group, whose component_id is its smallest doc_id that
isn't null; an empty table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, text_slices, utf8, written
from .components import components, hot_lookup

#: Fingerprints link at 2 * REACH differing bits or fewer.
REACH = 1
#: Fingerprints in a shard, about, and at least; in the tree's sample at most; in a shard that one task searches at most; in a leaf.
SHARD, SHARD_LEAST, SAMPLE, SHARD_MOST, LEAF = 1 << 20, 2048, 1 << 17, 1 << 22, 4096


def fingerprint(raw: bytes, words: int = 3, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    own = raw.lower().split()
    if not own:
        return 0
    line, n = b" ".join(own), max(1, len(own) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[min(words, len(own)) - 1 :].tolist()
    hashes = b"".join([xxhash.xxh64_digest(line[a:b], seed) for a, b in zip(first, last, strict=True)])
    return int(np.packbits(2 * _bits_set(hashes) > n).view(">u8")[0])


def _bits_set(hashes: bytes) -> np.ndarray:
    """For each bit, from the highest: in how many hashes (8 bytes each, the highest first) it is set."""
    raw = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    out = np.zeros(64, np.int64)
    for a in range(0, len(raw), 255):  # so that a byte can count a block
        out += np.unpackbits(raw[a : a + 255], axis=1).sum(0, dtype=np.uint8)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches):
        for batch in text_slices(batches):
            own = np.array([fingerprint(x) for x in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own)], ["doc_id", "fp"])

    df = id_and_text(docs, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp bigint")


def distances(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """The upper part of the tree as arrays: for node k its point, its radius and the node inside; the one outside is next.

    Nodes to which more than `most` of the sample go, copies counted, are split, where _split() finds a way.
    """

    def __init__(self, sample: np.ndarray, most: int, reach: int = REACH):
        points, radii, inside, todo = [np.uint64(0)], [64], [0], [(0, sample)]
        while todo:
            node, own = todo.pop()
            if len(own) <= most or (found := _split(own, reach)) is None:
                continue
            points[node], radii[node], inside[node] = *found, len(points)
            d = distances(own, found[0]).astype(np.int64)
            todo += [(len(points), own[d - reach <= found[1]]), (len(points) + 1, own[d + reach > found[1]])]
            for held, x in ((points, np.uint64(0)), (radii, 64), (inside, 0)):
                held += [x, x]
        self.points, self.radii, self.inside = np.array(points, np.uint64), np.array(radii, np.int64), np.array(inside, np.int64)

    @property
    def size(self) -> int:
        """How many shards there are."""
        return int((self.inside == 0).sum())

    def shards(self, fps: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) for each shard that the ball of a fingerprint meets."""
        row, node, rows, nodes = np.arange(len(fps)), np.zeros(len(fps), np.int64), [], []
        while len(row):
            leaf = self.inside[node] == 0
            rows.append(row[leaf]), nodes.append(node[leaf])
            row, node = row[~leaf], node[~leaf]
            d, m = distances(fps[row], self.points[node]).astype(np.int64), self.radii[node]
            low, high = d - reach <= m, d + reach > m
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([self.inside[node[low]], self.inside[node[high]] + 1])
        return np.concatenate([*rows, row]), np.concatenate([*nodes, node])


def _split(own: np.ndarray, reach: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius that parts them, or None where none does without many copies.

    With the shares a and b of them that go inside and outside, copies counted, all in all some (n / most) ** g rows of n
    come of such splits, where a ** g + b ** g = 1. The radius is the one with the least g: in a gap between clusters g is
    1, and else a small ball often is better than half of them, for its shell holds few.
    """
    v = _vantage(own)
    n = np.cumsum(np.bincount(distances(own, v), minlength=65 + reach)) / len(own)
    m = np.arange(65)
    a, b = n[m + reach], 1 - np.where(m >= reach, n[m - reach], 0)
    able = (a <= 63 / 64) & (b <= 63 / 64) & (a + b <= 1.5)
    if not able.any():
        return None
    m, a, b = m[able], a[able], b[able]
    low, high = np.ones(len(m)), np.full(len(m), 64.0)
    for _ in range(20):
        g = (low + high) / 2
        over = a**g + b**g > 1
        low, high = np.where(over, g, low), np.where(over, high, g)
    best = np.flatnonzero(high <= high.min() + 1e-3)
    return v, int(m[best[np.abs(a[best] - b[best]).argmin()]])


def _vantage(own: np.ndarray) -> np.uint64:
    """Of a few of them, the one whose distances to some others vary most."""
    step = max(1, len(own) // 64)
    some = own[::step][:64]
    spread = [distances(some, x).astype(float).var() for x in some[:16]]
    return some[int(np.argmax(spread))]


class _Forest:
    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def link(self, pairs) -> None:
        for i, j in pairs:
            a, b = self.top(i), self.top(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.edges.append((i, j))


def spanning_links(fps: np.ndarray, reach: int = REACH, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Pairs of places in fps (distinct values) that span the components of links at 2 * reach bits or fewer."""
    forest = _Forest(len(fps))
    todo = [np.arange(len(fps))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            own, pairs, n = fps[rows], [], 0
            for a in range(0, len(rows), 256):
                i, j = np.nonzero(distances(own[a : a + 256, None], own[None, a:]) <= 2 * reach)
                real = i < j
                pairs.append((rows[a + i[real]], rows[a + j[real]]))
                n += len(pairs[-1][0])
                if n > 16 * len(rows):
                    break
            if n > 16 * len(rows):  # a dense cluster
                _by_neighbours(fps, rows, forest)
            else:
                for i, j in pairs:
                    forest.link(zip(i.tolist(), j.tolist(), strict=True))
            continue
        found = _split(fps[rows], reach)
        if found is not None:
            d = distances(fps[rows], found[0]).astype(np.int64)
            todo += [rows[d - reach <= found[1]], rows[d + reach > found[1]]]
        else:  # a dense cluster, which splitting doesn't part
            _by_neighbours(fps, rows, forest)
    return forest.edges


_FLIPS = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])


def _by_neighbours(fps: np.ndarray, rows: np.ndarray, forest: _Forest) -> None:
    """Links of fingerprints that share a neighbour at one bit or are one; for each fingerprint 65 keys."""
    keys = (fps[rows][:, None] ^ _FLIPS[None, :]).reshape(-1)
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    at = np.repeat(rows, len(_FLIPS))[order]
    forest.link(zip(at[same].tolist(), at[same + 1].tolist(), strict=True))


def links(distinct: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """a, b: fingerprints that span the components. distinct: a written table of distinct fp."""
    spark, n = distinct.sparkSession, distinct.count()
    # Smaller ones where there would be fewer than tasks.
    shard = min(shard, max(SHARD_LEAST, -(-n // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    rate = int(min(0.9 * sample / max(1, n), 1 / 16) * (1 << 30))
    few = distinct.select("fp").where(F.expr(f"pmod(xxhash64(fp), {1 << 30}) < {rate}")).take(sample)
    few = np.sort(np.array([r[0] for r in few], np.int64)).view(np.uint64)
    tree = spark.sparkContext.broadcast(Tree(few, max(8, int(shard * len(few) / max(1, n)))))  # `sample` nodes at most

    def route(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            row, node = tree.value.shards(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(fps[row])], ["shard", "fp"])

    routed = written(distinct.select("fp").mapInArrow(route, "shard bigint, fp bigint"), "shards")
    # Too large for a task: at most one shard in SHARD_MOST rows, so these numbers are few.
    large = routed.groupBy("shard").count().where(F.col("count") > SHARD_MOST).select("shard")

    def search(rows: pa.Table) -> pa.Table:
        fps = np.unique(rows["fp"].to_numpy())
        pairs = np.array(spanning_links(fps.view(np.uint64)), np.int64).reshape(-1, 2)
        return pa.table({"a": fps[pairs[:, 0]], "b": fps[pairs[:, 1]]})

    found = routed.join(F.broadcast(large), "shard", "left_anti").groupBy("shard").applyInArrow(search, "a bigint, b bigint")
    if large.isEmpty():
        return found
    flips = ", ".join(str(x) for x in _FLIPS.view(np.int64).tolist())
    keys = routed.join(F.broadcast(large), "shard").select("fp").distinct().select("fp", F.explode(F.expr(f"transform(array({flips}), x -> x ^ fp)")).alias("key"))
    met = keys.groupBy("key").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    return found.unionByName(met.select(F.explode("all").alias("a"), "b").where("a <> b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row."""
    own = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct")
    nodes = components(links(distinct))
    # The component's smallest doc_id, by its smallest fingerprint; most fingerprints are alone.
    joined = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    table = joined.join(least, "component").select("fp", "component_id", "n")
    out = hot_lookup(own, written(table, "groups"), "fp", "n")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
