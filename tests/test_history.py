"""Commit graphs against a plain walk."""

import random

from pyspark.sql import functions as F

from recordloom.operators import history
from recordloom.plans import change
from recordloom.sources.stored import written
from tests.conftest import rows


def graph(seed, n, tips):
    """Commits 1 to n, each of one to three earlier ones; the last `tips` of which no other is made."""
    rng = random.Random(seed)
    return {k: sorted({max(1, k - rng.choice([1, 1, 1, 2, 3, 9])) for _ in range(rng.choice([1, 1, 1, 2, 3]))} - {0} if k > 1 else []) for k in range(1, n + 1)} | {n + k: [rng.randrange(1, n)] for k in range(1, tips + 1)}


def walk(parents, head):
    seen, todo = set(), [head] if head in parents else []
    while todo:
        k = todo.pop()
        if k not in seen:
            seen.add(k)
            todo += [p for p in parents[k] if p in parents]
    return seen


def tables(spark, repos, heads):
    commits = spark.createDataFrame([(r, k, ps, f"a{k % 7}") for r, g in repos.items() for k, ps in g.items()], "repo_id string, id bigint, parents array<bigint>, author string")
    return commits, spark.createDataFrame(heads, "repo_id string, label string, id bigint")


def test_reachable_commits_and_merge_bases(spark):
    repos = {"a": graph(1, 60, 4), "b": graph(2, 40, 3), "line": {k: [k - 1] for k in range(1, 200)}, "two": {1: [], 2: [], 3: [1, 2], 4: [1, 2]}, "shallow": {5: [4], 6: [5]}}
    heads = [("a", "x", 60), ("a", "y", 63), ("b", "x", 40), ("b", "y", 20), ("line", "x", 150), ("line", "y", 199), ("two", "x", 3), ("two", "y", 4), ("shallow", "x", 6), ("shallow", "lost", 9)]
    commits, named = tables(spark, repos, heads)
    reached = history.reachable(commits, named)
    assert {tuple(r) for r in reached.collect()} == {(r, label, k) for r, label, h in heads for k in walk(repos[r], h)} and reached.count() == reached.distinct().count()
    want = set()
    for r, g in repos.items():
        own = {label: walk(g, h) for q, label, h in heads if q == r}
        both = own.get("x", set()) & own.get("y", set())
        want |= {(r, k) for k in both if not any(k in g[c] for c in both)}
    assert {tuple(r) for r in history.merge_bases(commits, reached, "x", "y").collect()} == want and ("two", 1) in want and ("two", 2) in want


def test_a_log_in_order_is_settled_in_blocks(spark, monkeypatch):
    # A line of blocks: each commit is written a few times in all, not once in each round of jumps.
    n, rows_written = 600, []

    def counted(df, name):
        out = written(df, name)
        rows_written.append(out.count())
        return out

    monkeypatch.setattr(history, "BLOCK", 16)
    monkeypatch.setattr(history, "written", counted)
    commits, named = tables(spark, {"line": {k: [k - 1] for k in range(1, n + 1)}}, [("line", "x", n)])
    assert history.reachable(commits, named).count() == n
    assert sum(rows_written) < 6 * n


def test_blocks_in_any_order(spark, monkeypatch):
    # Blocks of seven rows, in the log's order and in none; a commit twice is one.
    monkeypatch.setattr(history, "BLOCK", 7)
    repos, heads = {"a": graph(5, 60, 4), "b": graph(6, 50, 3)}, [("a", "x", 60), ("a", "y", 63), ("b", "x", 50), ("b", "y", 25)]
    commits, named = tables(spark, repos, heads)
    want = {(r, label, k) for r, label, h in heads for k in walk(repos[r], h)}
    for log in (commits, commits.unionByName(commits.limit(9)).orderBy(F.xxhash64("id"))):
        reached = history.reachable(log, named)
        assert {tuple(r) for r in reached.collect()} == want and reached.count() == len(want)


def test_statistics(spark):
    repos = {"a": graph(3, 50, 3), "none": {1: []}}
    commits, _ = tables(spark, repos, [("a", "x", 50)])
    tags = spark.createDataFrame([("a", f"v{k}", k) for k in (5, 11, 12, 30, 44, 47, 52)] + [("a", "again", 47)], "repo_id string, tag string, id bigint")
    heads = spark.createDataFrame([("a", 50), ("none", 2)], "repo_id string, id bigint")
    own = walk(repos["a"], 50)
    latest = max(((len(walk(repos["a"], k)), t) for t, k in [(f"v{k}", k) for k in (5, 11, 12, 30, 44, 47, 52)] + [("again", 47)] if k in own))[1]
    assert rows(history.statistics(commits, heads, tags)) == [("a", len(own), "50", latest, len({k % 7 for k in own})), ("none", 0, None, None, 0)]


def test_changed_paths(spark):
    trees = spark.createDataFrame([("a", 1, "x", "1"), ("a", 1, "y", "1"), ("a", 2, "x", "2"), ("a", 2, "z", "1"), ("a", 2, "y", "1"), ("b", 1, "x", "1"), ("b", 2, "x", "1")], "repo_id string, id bigint, path string, blob string")
    at = lambda k: spark.createDataFrame([("a", k), ("b", k)], "repo_id string, id bigint")
    assert rows(history.changed_paths(trees, at(1), at(2))) == [("a", "x"), ("a", "z")]
    commits = spark.createDataFrame([("a", 1, []), ("a", 2, [1]), ("a", 3, [1])], "repo_id string, id bigint, parents array<bigint>")
    assert rows(change.changed_since(commits, trees, at(3), at(2))) == [("a", "x"), ("a", "z")]
    assert history.reachable(*(trees.selectExpr("repo_id", "id", "array(id) AS parents").limit(0), at(1).selectExpr("repo_id", "'x' AS label", "id"))).count() == 0
