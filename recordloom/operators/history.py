"""Commit graphs held as tables: what can be reached from a head, merge bases, statistics of a repository, changed paths.

A commit with one child can be reached from a head just where its child can, so it hangs on it; so does a commit all whose
children hang on one and the same commit. Hanging is followed to its end by pointer jumping, in a number of rounds that
grows with the logarithm of a history's length, and takes in chains, branches that were merged, and branches within
branches. Only what is left, commits whose children hang on several, is walked from the heads step by step; merges across
branches are few in any history, and a step takes all repositories at once.

Most of that needs no rounds: commits are dealt to blocks of BLOCK rows in the log's own order, in which parents are near,
and each block is settled by one task in one pass. The rounds go on with the commits that have a child in another block or
hang on several; a log without any order leaves all of them to the rounds.

commits: (repo_id, id, parents); parents that aren't commits themselves (of a shallow clone) are left out, a null list is
an empty one. Each round is a written table. An id is told apart within its repository.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators import relational as ops
from recordloom.sources.stored import written

#: Rows of a log that are settled together.
BLOCK = 1 << 16


def edges_of(commits: DataFrame) -> DataFrame:
    """repo_id, child and parent."""
    own = commits.select("repo_id", F.col("id").alias("child"), F.explode("parents").alias("parent")).distinct()
    return own.join(commits.select("repo_id", F.col("id").alias("parent")).distinct(), ["repo_id", "parent"], "left_semi").select("repo_id", "child", "parent")


def _jumped(hangs: DataFrame) -> DataFrame:
    """hangs (repo_id, id, on) with `on` replaced by what it hangs on itself, to the end; a round jumps twice."""
    hangs = written(hangs, "hangs")
    while True:
        above = hangs.select("repo_id", F.col("id").alias("on"), F.col("on").alias("above"))
        once = hangs.join(above, ["repo_id", "on"], "left").select("repo_id", "id", F.coalesce("above", "on").alias("on"), F.col("above").isNotNull().alias("moved"))
        hangs = written(once.join(above, ["repo_id", "on"], "left").select("repo_id", "id", F.coalesce("above", "on").alias("on"), "moved"), "hangs")
        if hangs.where("moved").isEmpty():
            return hangs.drop("moved")


def _blocks(commits: DataFrame) -> DataFrame:
    """commits with the block of each row, as a written table."""
    if "block" in commits.columns:
        return commits
    return written(commits.withColumn("block", F.expr(f"monotonically_increasing_id() div {BLOCK}")), "blocks")


def _settle(rows: pa.Table) -> pa.Table:
    """Of one block's rows (repo_id, id, fixed, child): each commit with what it hangs on, null where no head is above, and with
    itself if that isn't known here; then the edges (child, parent) to those that hang on themselves.
    """
    key = {}  # numbers of the block's commits, then of children elsewhere
    repo = rows.column("repo_id").to_pylist()
    own = [key.setdefault(x, len(key)) for x in zip(repo, rows.column("id").to_pylist(), strict=True)]
    n, fixed, links = len(key), set(), set()
    for v, r, c, f in zip(own, repo, rows.column("child").to_pylist(), rows.column("fixed").to_pylist(), strict=True):
        if f:
            fixed.add(v)
        if c is not None:
            links.add((key.setdefault((r, c), len(key)), v))
    children, parents, waits = [[] for _ in range(n)], [[] for _ in range(n)], [0] * n
    for c, v in links:
        children[v].append(c)
        if c < n:
            parents[c].append(v)
            waits[v] += 1
    on = [*range(len(key))]
    todo = [v for v in range(n) if not waits[v]]
    while todo:  # children first
        v = todo.pop()
        if v not in fixed:
            above = {on[c] for c in children[v]} - {None}
            one = next(iter(above)) if len(above) == 1 else v
            on[v] = None if not above else one if one < n else v
        for p in parents[v]:
            waits[p] -= 1
            if not waits[p]:
                todo.append(p)
    names = [*key]
    edges = {(on[c], v) for v in range(n) if on[v] == v for c in children[v] if on[c] is not None}
    out = [(*names[v], names[on[v]][1] if on[v] is not None else None, v in fixed, None) for v in range(n)] + [(names[v][0], names[c][1], None, None, names[v][1]) for c, v in edges]
    kind = rows.schema.field("id").type
    schema = pa.schema([("repo_id", rows.schema.field("repo_id").type), ("id", kind), ("on", kind), ("fixed", pa.bool_()), ("parent", kind)])
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def _settled(commits: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo_id, id, on, fixed) of all commits, settled within their blocks, and (repo_id, child, parent) of the edges left."""
    key = ["repo_id", "id"]
    own, kind = _blocks(commits), lambda c: commits.schema[c].dataType.simpleString()
    links = own.select("repo_id", F.explode("parents").alias("id"), F.col("id").alias("child"))
    rows = own.groupBy(*key).agg(F.min("block").alias("block")).join(links, key, "left").join(fixed.withColumn("fixed", F.lit(True)), key, "left")
    done = rows.groupBy("block").applyInArrow(_settle, f"repo_id {kind('repo_id')}, id {kind('id')}, on {kind('id')}, fixed boolean, parent {kind('id')}")
    done = written(done, "settled")
    nodes, edges = done.where("parent IS NULL").drop("parent"), done.where("parent IS NOT NULL").select("repo_id", "id", "parent")
    edges = nodes.where("on IS NOT NULL").drop("fixed").join(edges, key).select("repo_id", F.col("on").alias("child"), "parent").distinct()
    return nodes, edges


def anchors(commits: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo_id, id, on) of the commits that hang on another, and (repo_id, child, parent) between those that don't.

    heads (repo_id, id) never hang, and what hangs on a commit can be reached from a head just where that commit can.
    Branches that end in no head are taken away, with all that hangs on them.
    """
    key = ["repo_id", "id"]
    fixed = written(heads.select(*key).distinct(), "heads")
    nodes, edges = _settled(commits, fixed)
    edges = written(edges, "edges")
    loose = written(nodes.where("id = on AND NOT fixed").select(*key), "loose")  # neither a head, nor hanging, nor taken away
    hangs, kernel = _rounds(edges, loose, fixed)
    up = hangs.select("repo_id", F.col("id").alias("on"), F.col("on").alias("up"))
    below = nodes.where("id <> on").join(up, ["repo_id", "on"], "left").select(*key, F.coalesce("up", "on").alias("on"))
    return hangs.unionByName(below), kernel


def _rounds(edges: DataFrame, loose: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """anchors of a graph by its edges, its commits but for the heads, and the heads: rounds of joins."""
    key = ["repo_id", "id"]
    hangs = dead = loose.limit(0)
    hangs = hangs.withColumn("on", F.col("id"))
    while True:
        children = edges.join(hangs.select("repo_id", F.col("id").alias("child"), "on"), ["repo_id", "child"], "left").select("repo_id", F.coalesce("on", "child").alias("child"), F.col("parent").alias("id"))
        children = children.join(dead.select("repo_id", F.col("id").alias("child")), ["repo_id", "child"], "left_anti")
        own = loose.join(children.groupBy(*key).agg(F.min("child").alias("on"), F.max("child").alias("most")), key, "left")
        own = written(own, "own")
        gone, more = own.where("on IS NULL").select(*key), own.where("on = most").select(*key, "on")
        if own.where("on IS NULL OR on = most").isEmpty():
            kernel = children.join(own.select(*key).unionByName(fixed), key, "left_semi")
            return hangs, written(kernel.select("repo_id", "child", F.col("id").alias("parent")).distinct(), "kernel")
        loose, dead = own.where("on <> most").select(*key), dead.unionByName(gone)
        hangs = _jumped(hangs.unionByName(more))


def reachable(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """repo_id, label and id of the commits that can be reached from each head (repo_id, label, id), the head included."""
    hangs, kernel = anchors(commits, heads)
    known = heads.select("repo_id", "label", "id").distinct().join(commits.select("repo_id", "id").distinct(), ["repo_id", "id"], "left_semi")
    reached = last = written(known.select("repo_id", "label", "id"), "reached")
    while not last.isEmpty():
        step = last.join(kernel.select("repo_id", F.col("child").alias("id"), "parent"), ["repo_id", "id"]).select("repo_id", "label", F.col("parent").alias("id")).distinct()
        last = written(step.join(reached, ["repo_id", "label", "id"], "left_anti"), "reached")
        reached = reached.unionByName(last)
    below = hangs.join(reached.select("repo_id", "label", F.col("id").alias("on")), ["repo_id", "on"]).select("repo_id", "label", "id")
    return written(reached.unionByName(below), "reachable")


def merge_bases(commits: DataFrame, reached: DataFrame, left: str, right: str) -> DataFrame:
    """repo_id and id of the best common ancestors of the heads of two labels: common ones without a common child."""
    both = reached.where(F.col("label") == left).select("repo_id", "id").join(reached.where(F.col("label") == right).select("repo_id", "id"), ["repo_id", "id"], "left_semi")
    older = edges_of(commits).join(both.select("repo_id", F.col("id").alias("child")), ["repo_id", "child"], "left_semi").select("repo_id", F.col("parent").alias("id"))
    return both.join(older, ["repo_id", "id"], "left_anti")


def changed_paths(trees: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """repo_id and path of the files that differ between the trees (repo_id, id, path, blob) of two commits (repo_id, id)."""
    a, b = (trees.join(x.select("repo_id", "id").distinct(), ["repo_id", "id"], "left_semi").select("repo_id", "path", "blob") for x in (old, new))
    once = ops.coverage(a, b, ["repo_id", "path", "blob"]).where("side <> 'both'")
    return once.select("repo_id", "path").distinct()


def statistics(commits: DataFrame, heads: DataFrame, tags: DataFrame) -> DataFrame:
    """repo_id, commits, head (seven characters), latest_tag and contributors of the head (repo_id, id) of each repository.

    commits has an author as well; tags: (repo_id, tag, id). The latest tag is the one from which the fewest of the head's
    commits can't be reached, of equal ones the greatest name. A repository whose head is no commit has none, and nulls.
    """
    commits = _blocks(commits)
    head = heads.select("repo_id", "id").distinct()
    tagged = tags.select("repo_id", "tag", "id").distinct()
    reached = reachable(commits, head.select("repo_id", F.lit("").alias("label"), "id"))
    own = reached.select("repo_id", "id")
    counts = own.join(commits.select("repo_id", "id", "author"), ["repo_id", "id"]).groupBy("repo_id").agg(F.count_distinct("id").alias("commits"), F.count_distinct("author").alias("contributors"))
    # Of reachable tags only those count below which no other lies nearer to the head: the last tags of each branch.
    seen = written(tagged.join(own, ["repo_id", "id"], "left_semi"), "tags")
    near = _last_tags(commits, own, seen)
    among = reachable(commits, near.select("repo_id", F.col("id").alias("label"), "id")).join(own, ["repo_id", "id"], "left_semi").groupBy("repo_id", F.col("label").alias("id")).agg(F.count("*").alias("n"))
    latest = seen.join(among, ["repo_id", "id"]).groupBy("repo_id").agg(F.max_by("tag", F.struct("n", "tag")).alias("latest_tag"))
    out = head.join(counts, "repo_id", "left").join(latest, "repo_id", "left")
    return out.select("repo_id", F.coalesce("commits", F.lit(0)).alias("commits"), F.when(F.col("commits").isNotNull(), F.substring(F.col("id").cast("string"), 1, 7)).alias("head"), "latest_tag", F.coalesce("contributors", F.lit(0)).alias("contributors"))


def _last_tags(commits: DataFrame, own: DataFrame, seen: DataFrame) -> DataFrame:
    """repo_id and id of tagged commits that no other tagged commit leads to: a walk from the head that stops at tags.

    Cutting the edges below tagged commits leaves just those within its reach; a tag behind another may be among them where
    a second way leads to it, which does no harm.
    """
    stops = seen.select("repo_id", "id").distinct()
    cut = commits.join(own, ["repo_id", "id"], "left_semi").join(stops.withColumn("stop", F.lit(True)), ["repo_id", "id"], "left")
    cut = cut.select("repo_id", "id", "block", F.when(F.col("stop"), F.array().cast(commits.schema["parents"].dataType)).otherwise(F.col("parents")).alias("parents"))
    top = cut.select("repo_id", "id").join(edges_of(commits.join(own, ["repo_id", "id"], "left_semi")).select("repo_id", F.col("parent").alias("id")), ["repo_id", "id"], "left_anti")
    return reachable(cut, top.select("repo_id", F.lit("").alias("label"), "id")).join(stops, ["repo_id", "id"], "left_semi").select("repo_id", "id")
