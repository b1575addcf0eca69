"""Components of rows that share keys: candidates are compared in blocks of bounded size, by sketches first and then by their sets.

Candidates are rows with a key in common. Each row is first compared with the least row of those that it shares most keys
with. From then on only keys matter that rows of several components share. As long as over LARGE rows share one, there
are rounds: its rows are dealt to blocks of BLOCK at most, another way each time, and each takes the first row of its
block, of another component, whose sketch allows a link, so that a large group of copies is linked by a few comparisons
of each of its rows; a key that is one block is dealt once, since it would be the same block again. When a round doesn't
link a tenth of its pairs, or no such key is left, all pairs of rows of
different components that still share a key are held against each other by their sketches within tasks, two blocks at a
time; those whose sketches allow a link, and only these, leave the task to be verified. No pair is left out, no key is
capped, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Rows that share a key at which rounds begin, and rows of a block at most.
LARGE, BLOCK = 128, 2048

#: Whether rows may be linked: (place, sketch) of one row and (places, sketches) of others that share its key.
Possible = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _by_blocks(df: DataFrame, pairs: Callable, schema: str) -> DataFrame:
    """pairs() of each block (rows of equal h and block, by row), which a task reads in order; it holds one block and one batch."""

    def run(batches):
        names, kept = [x.split()[0] for x in schema.split(", ")], None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            own = own if kept is None else pa.concat_tables([kept, own])
            h, block = own["h"].to_numpy(), own["block"].to_numpy()
            ends = np.flatnonzero((h[1:] != h[:-1]) | (block[1:] != block[:-1])) + 1
            last = int(ends[-1]) if len(ends) else 0
            kept = own.slice(last)
            if last:
                yield from found(own.slice(0, last), np.concatenate([[0], ends]), names)
        if kept is not None and kept.num_rows:
            yield from found(kept, np.array([0, kept.num_rows]), names)

    def found(rows, ends, names):
        columns = {c: rows[c].to_numpy() for c in ("row", "met", "place", "side")}
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out = pairs(*(columns[c][a:b] for c in ("row", "met", "place", "side")), sketch[a:b])
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    return df.repartition("h", "block").sortWithinPartitions("h", "block", "row").mapInArrow(run, schema)


def _forest(possible: Possible):
    """Pairs of a block that may be linked and, if all of them were, would join what any such pair could: a, b, their components."""

    def pairs(row, met, place, side, sketch):
        label, left, right = np.unique(met, return_inverse=True)[1], [], []
        for i in range(len(row) - 1):
            todo = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            if len(todo):
                todo = todo[possible(place[i], sketch[i], place[todo], sketch[todo])]
                others, first = np.unique(label[todo], return_index=True)
                left.append(np.full(len(others), i)), right.append(todo[first])
                label[np.isin(label, others)] = label[i]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return row[a], row[b], met[a], met[b]

    return pairs


def _all(possible: Possible):
    """All pairs of rows of a block, of different components and sides, that may be linked: a < b."""

    def pairs(row, met, place, side, sketch):
        left, right = [], []
        for i in range(len(row) - 1):
            todo = np.flatnonzero((met[i + 1 :] != met[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 2))) + i + 1
            if len(todo):
                todo = todo[possible(place[i], sketch[i], place[todo], sketch[todo])]
                left.append(np.full(len(todo), i)), right.append(todo)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return row[a], row[b]

    return pairs


def linked(entries: DataFrame, nodes: DataFrame, possible: Possible, verify: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> DataFrame:
    """node and component of the rows that links join. entries: h (key), row and place; nodes: row and sketch (of equal length).

    verify(pairs) gives the links among pairs of rows (a, b), as a written table; known: further pairs, to be verified with the
    first ones. Rows without a link are left out.
    """
    groups = entries.groupBy("h").agg(F.count("*").alias("size"), F.min("row").alias("least")).where("size > 1")
    shared = written(entries.join(groups.select("h", "least"), "h"), "shared")
    most = shared.where("least < row").groupBy("row", "least").count().groupBy("row").agg(F.max(F.struct("count", (-F.col("least")).alias("least"))).alias("m"))
    first = most.select((-F.col("m.least")).alias("a"), F.col("row").alias("b"))
    found = verify(first if known is None else first.unionByName(known).distinct())
    met = components(found).withColumnRenamed("node", "row")
    left = written(shared.select("h", "row", "place").join(met, "row", "left").select("h", "row", "place", F.coalesce("component", "row").alias("met")), "met")
    k = 0
    while True:
        # Keys that rows of several components share.
        several = written(left.groupBy("h").agg(F.count("*").alias("n"), F.min("met").alias("low"), F.max("met").alias("high")).where("low < high").select("h", "n"), "several")
        large = several.where(F.col("n") > (BLOCK if k else LARGE))
        if large.isEmpty():
            break
        k += 1
        dealt = left.join(large, "h").withColumn("block", F.pmod(F.xxhash64("row", F.lit(k)), F.ceil(F.col("n") / BLOCK)))
        near = _by_blocks(dealt.join(nodes, "row").select("h", "block", "row", "met", "place", F.lit(2).alias("side"), "sketch"), _forest(possible), "a bigint, b bigint, c bigint, d bigint")
        # One pair of each two components.
        taken = near.groupBy(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).agg(F.min(F.struct("a", "b")).alias("t"))
        taken = written(taken.select("t.a", "t.b", "c", "d"), "taken")
        more = verify(taken.select("a", "b"))
        compared, joined = taken.count(), more.count()
        found = found.unionByName(more)
        # Components that are linked now are one.
        joint = components(taken.join(more, ["a", "b"], "left_semi").select(F.col("c").alias("a"), F.col("d").alias("b"))).withColumnRenamed("node", "met")
        left = written(left.join(joint, "met", "left").select("h", "row", "place", F.coalesce("component", "met").alias("met")), "met")
        if 10 * joined < compared or not compared:
            several = written(left.groupBy("h").agg(F.count("*").alias("n"), F.min("met").alias("low"), F.max("met").alias("high")).where("low < high").select("h", "n"), "several")
            break
    # Blocks of a key in twos: the one with itself (side 2), or with another (sides 0 and 1).
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = left.join(several, "h").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rest = rest.select("h", (low.cast("bigint") * F.col("parts") + high).alias("block"), "row", "met", "place", side.alias("side"))
    pairs = _by_blocks(rest.join(nodes, "row").select("h", "block", "row", "met", "place", "side", "sketch"), _all(possible), "a bigint, b bigint")
    return components(found.unionByName(verify(pairs.distinct())))
