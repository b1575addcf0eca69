"""Cycles of directed graphs held as edge tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.relational import sorted_if_many

#: Edges of a scope, at most, that one task takes whole, and rounds in which it trims them all at once.
WHOLE, TRIMS = 1 << 20, 16


def _cut(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read again, so that rounds don't grow the plan.

    Where that is unset, df is kept by a local session, and on a cluster this raises: its executors share no other folder.
    """
    context = df.sparkSession.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        return df.persist()
    path = f"{where.rstrip('/')}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fixpoint(df: DataFrame, step, state) -> tuple[DataFrame, tuple]:
    """df after so many steps that state(df), a row of aggregates, no longer changes."""
    df, known = _cut(df), None
    while True:
        now = tuple(state(df))
        if now == known:
            return df, now
        df, known = _cut(step(df)), now


def trimmed(edges: DataFrame, scope: str = "repo_id") -> tuple[DataFrame, int]:
    """The edges left, and their number, when nodes that no edge enters or none leaves are taken away until there are none."""

    def step(e: DataFrame) -> DataFrame:
        heads, tails = e.select(scope, F.col("dst").alias("src")).distinct(), e.select(scope, F.col("src").alias("dst")).distinct()
        return e.join(heads, [scope, "src"], "left_semi").join(tails, [scope, "dst"], "left_semi").select(scope, "src", "dst")

    left, (n,) = _fixpoint(edges.select(scope, "src", "dst").distinct(), step, lambda e: e.agg(F.count("*")).first())
    return left, n


def on_cycles(edges: DataFrame, scope: str = "repo_id") -> DataFrame:
    """(scope, node, component): nodes on cycles, and the smallest node that each shares a cycle with.

    A scope of WHOLE edges at most is one task's, which needs no rounds; the others go through them.
    """
    own = _cut(edges.select(scope, "src", "dst").dropna().distinct())
    large = own.groupBy(scope).count().where(F.col("count") > WHOLE).select(scope)
    kinds = {x.name: x.dataType.simpleString() for x in own.schema}
    schema = f"{scope} {kinds[scope]}, node {kinds['src']}, component {kinds['src']}"
    if large.isEmpty():
        return own.groupBy(scope).applyInArrow(_knots(scope), schema)
    few = own.join(large, scope, "left_anti").groupBy(scope).applyInArrow(_knots(scope), schema)
    return few.unionByName(_on_cycles_by_rounds(own.join(large, scope, "left_semi"), scope))


def _knots(scope: str):
    """For the distinct edges of one scope: its nodes on cycles and their components' smallest nodes."""

    def found(rows: pa.Table) -> pa.Table:
        names = pc.unique(pa.chunked_array([*rows["src"].chunks, *rows["dst"].chunks]))
        src, dst = (pc.index_in(rows[c], names).to_numpy() for c in ("src", "dst"))
        for _ in range(TRIMS):
            # Nodes that no edge enters, or none leaves.
            keep = (np.bincount(dst, minlength=len(names)) > 0)[src] & (np.bincount(src, minlength=len(names)) > 0)[dst]
            if keep.all():
                break
            src, dst = src[keep], dst[keep]
        there, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        src, dst = at[: len(src)], at[len(src) :]
        component = _strong(src, dst, len(there))
        # A component of one node is a cycle only by an edge to itself.
        real = np.bincount(component, minlength=len(there))[component] > 1
        real[src[src == dst]] = True
        nodes, component = names.take(pa.array(there[real])), component[real]
        least = pa.table({"c": component, "node": nodes}).group_by("c").aggregate([("node", "min")])
        component = least["node_min"].take(pc.index_in(pa.array(component), least["c"]))
        return pa.table({scope: pc.take(rows[scope], pa.array(np.zeros(len(nodes), np.int64))), "node": nodes, "component": component})

    return found


def _strong(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes a node of its strongly connected component, the same for all of it (Tarjan's walk, without recursion)."""
    order = np.argsort(src, kind="stable")
    heads, starts = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    at, number, low, of = starts[:-1], [-1] * n, [0] * n, [-1] * n
    count, waiting = 0, []
    for root in range(n):
        path = [] if number[root] >= 0 else [root]
        while path:
            v = path[-1]
            if number[v] < 0:
                number[v] = low[v] = count
                count += 1
                waiting.append(v)
            if at[v] < starts[v + 1]:
                w = heads[at[v]]
                at[v] += 1
                if number[w] < 0:
                    path.append(w)
                elif of[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == number[v]:
                w = -1
                while w != v:
                    w = waiting.pop()
                    of[w] = v
    return np.array(of, np.int64)


def _on_cycles_by_rounds(edges: DataFrame, scope: str) -> DataFrame:
    """on_cycles() by rounds over all edges.

    Nodes off all cycles are trimmed first. Then each node takes the least node from which it can be reached, as its
    colour; of a colour, those that reach the node it is named for are one component, and are taken away; and so on with
    the edges left within colours. Every table has a row for an edge or a node, never for a pair of connected nodes;
    rounds are as many as paths between cycles are long, and components one behind another.
    """
    left, n = trimmed(edges, scope)
    found = left.select(scope, F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    total = lambda c: F.sum(F.xxhash64(scope, "node", c).cast("decimal(38,0)"))
    while n:
        nodes = left.select(scope, F.col("src").alias("node"), F.col("src").alias("colour")).distinct()  # trimmed, so each has an edge out

        def spread(own: DataFrame, edges: DataFrame = left) -> DataFrame:
            there = edges.join(own.withColumnRenamed("node", "src"), [scope, "src"]).select(scope, F.col("dst").alias("node"), "colour")
            return own.unionByName(there).groupBy(scope, "node").agg(F.min("colour").alias("colour"))

        colours, _ = _fixpoint(nodes, spread, lambda own: own.agg(F.count("*"), total("colour")).first())
        a, b = (colours.select(scope, F.col("node").alias(c), F.col("colour").alias(f"of_{c}")) for c in ("src", "dst"))
        inner = _cut(left.join(a, [scope, "src"]).join(b, [scope, "dst"]).where("of_src = of_dst").select(scope, "src", "dst", F.col("of_src").alias("colour")))

        def back(own: DataFrame, edges: DataFrame = inner) -> DataFrame:
            behind = edges.join(own.withColumnRenamed("node", "dst"), [scope, "dst", "colour"], "left_semi").select(scope, F.col("src").alias("node"), "colour")
            return own.unionByName(behind).distinct()

        whole, _ = _fixpoint(colours.where("node = colour"), back, lambda own: own.agg(F.count("*")).first())
        # A component of one node is a cycle only by an edge to itself.
        loops = left.where("src = dst").select(scope, F.col("src").alias("node"))
        sizes = whole.groupBy(scope, "colour").agg(F.count("*").alias("size"))
        real = whole.join(sizes.where("size > 1").select(scope, "colour"), [scope, "colour"], "left_semi").unionByName(whole.join(sizes.where("size = 1").select(scope, "colour"), [scope, "colour"], "left_semi").join(loops, [scope, "node"], "left_semi").select(whole.columns))
        found = found.unionByName(real.select(scope, "node", F.col("colour").alias("component")))
        gone = whole.select(scope, F.col("node").alias("src"))
        left, n = trimmed(inner.join(gone, [scope, "src"], "left_anti").join(gone.withColumnRenamed("src", "dst"), [scope, "dst"], "left_anti"), scope)
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """repo_id, node and cycle (its nodes in order, the first again at the end) of each cycle that a walk closes.

    edges: repo_id, src, dst, src_ord, pos. Nodes are walked depth first in the order of src_ord, their edges by pos; a
    walk that meets a node on its own path has closed a cycle, told once for each set of nodes. Only the nodes of
    cycles go to the walk, a task for each component, so what a task gathers is a tangle, not a graph.
    """
    tangled = _cut(on_cycles(edges))
    # A component is named for its least node, so others are in it where it is more than that one.
    several = _cut(tangled.join(tangled.where("node <> component").select("repo_id", "component").distinct(), ["repo_id", "component"], "left_semi"))
    alone = tangled.join(sorted_if_many(several), ["repo_id", "component"], "left_anti").select("repo_id", "node", F.array("node", "node").alias("cycle"))
    a, b = (sorted_if_many(several.select("repo_id", F.col("node").alias(c), F.col("component").alias(of))) for c, of in (("src", "component"), ("dst", "_b")))
    inner = edges.join(a, ["repo_id", "src"]).join(b, ["repo_id", "dst"]).where("component = _b").select("repo_id", "component", "src", "dst", "src_ord", "pos")

    def walked(own: list[tuple]) -> pa.RecordBatch:
        rings = [(repo, ring[-1], [*ring, ring[0]]) for (repo, _), edges in own for ring in _closed(edges)]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip([*zip(*rings, strict=True)] or [[]] * 3, (pa.string(), pa.string(), pa.list_(pa.string())), strict=True)], ["repo_id", "node", "cycle"])

    def walk(batches):
        # Components come one behind the other; the last one of a batch may go on in the next.
        last = []
        for batch in batches:
            own = last
            for repo, component, src, dst in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not own or own[-1][0] != (repo, component):
                    own.append(((repo, component), []))
                own[-1][1].append((src, dst))
            last = own[-1:]
            yield walked(own[:-1])
        yield walked(last)

    dealt = inner.repartition("repo_id", "component").sortWithinPartitions("repo_id", "component", "src_ord", "pos")
    return alone.unionByName(dealt.mapInArrow(walk, "repo_id string, node string, cycle array<string>"))


def _closed(edges: list[tuple[str, str]]) -> list[list[str]]:
    """The cycles that a depth-first walk closes, in the order in which it does; edges come in the walk's order."""
    following: dict[str, list[str]] = {}
    for src, dst in edges:
        following.setdefault(src, []).append(dst)
    depth: dict[str, int] = {}  # of nodes on the path; -1 for those that are done with
    path: list[str] = []
    rings: dict[frozenset, list[str]] = {}
    # A stack of edges to try, each with the depth of the node that it leaves.
    stack = [(0, node) for node in reversed(following)]
    while stack:
        at, node = stack.pop()
        while len(path) > at:
            depth[path.pop()] = -1
        if node not in depth:
            depth[node] = at
            path.append(node)
            stack += [(at + 1, x) for x in reversed(following.get(node, []))]
        elif depth[node] >= 0:
            ring = path[depth[node] :]
            rings.setdefault(frozenset(ring), ring)
    return list(rings.values())
