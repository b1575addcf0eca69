import re

import pytest
from pyspark.sql import functions as F

from recordloom.operators import graph
from recordloom.operators import relational as ops
from recordloom.operators.patches import apply_patch, patched
from tests.conftest import rows


def test_reference_and_key_operators(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (2, "w")], "k int, v string")
    b = spark.createDataFrame([(1,), (1,)], "k int")
    assert rows(ops.dangling(a, b, ["k"])) == [(None, "z"), (2, "w"), (2, "y")]
    assert rows(ops.duplicates(a, ["k"])) == [(2, 2)]
    assert rows(ops.later_occurrences(a, ["k"], ["v"], "v").select("k", "v", "other")) == [(2, "y", "w")]
    assert rows(ops.first_by(a, ["k"], "v", ["v"])) == [(None, "z"), (1, "x"), (2, "w")]
    assert rows(ops.last_by(a, ["k"], "v", ["v"])) == [(None, "z"), (1, "x"), (2, "y")]
    assert rows(ops.coverage(a, b.unionByName(spark.range(9, 10).select(F.col("id").cast("int").alias("k"))), ["k"])) == [(None, "left"), (1, "both"), (2, "left"), (9, "right")]
    assert rows(ops.zero_filled(a, spark.createDataFrame([(2,), (5,)], "k int"), ["k"])) == [(2, 2), (5, 0)]


def test_memory_of_counts_does_not_grow_with_the_split(spark, monkeypatch):
    """One split of keys that occur once or twice and one frequent key: no partial counts of all that a task reads."""
    monkeypatch.setattr(ops, "TASK_ROWS", 100)
    a = spark.range(0, 1000, 1, 1).select(F.when(F.col("id") < 990, F.col("id") % 980).when(F.col("id") < 999, 7).alias("k"), F.lit("x").alias("v"))
    assert rows(ops.duplicates(a, ["k", "v"])) == sorted([(7, "x", 11), *((k, "x", 2) for k in range(10) if k != 7)], key=lambda r: str(r[0]))
    found = ops.duplicates(a, ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    deepest = {x: max(i for i, line in enumerate(plan) if x in line) for x in ("HashAggregate", "Exchange")}
    assert deepest["HashAggregate"] < deepest["Exchange"], plan
    assert ops.tasks_for(a) == 10 and found.rdd.getNumPartitions() == 10  # small partitions aren't put together again


def test_carry_forward_carries_null(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "x", False), (3, None, True), (4, "y", False)], "p int, v string, s boolean").withColumn("g", F.lit(1))
    assert [r["c"] for r in ops.carry_forward(df, ["g"], ["p"], F.col("s"), F.col("v"), "c").orderBy("p").collect()] == ["a", "a", None, None]


def test_gaps_and_ids(spark):
    used = spark.createDataFrame([(1,), (2,), (4,), (4,)], "n int")
    assert rows(ops.missing_values(used, "n", 1, 3)) == [(3, 1), (5, 2), (6, 3)]
    assert rows(ops.next_id(used, "n", 3)) == [("005",)]
    assert rows(ops.next_id(used.where("n > 9"), "n", 2, 7)) == [("07",)]
    assert rows(ops.next_id(spark.createDataFrame([("12345",)], "n string"), "n", 3)) == [("12346",)]


def test_overlaps_owners_prefixes(spark):
    m = spark.createDataFrame([("r", "i1", "s", 1), ("r", "i2", "s", 2), ("r", "i2", "t", 2), ("r", "i3", "t", 3), ("q", "i9", "s", 1)], "repo string, item string, scope string, o int")
    assert rows(ops.overlaps(m, ["repo"], "item", "scope", "o")) == [("r", "i1", "i2", ["s"]), ("r", "i2", "i3", ["t"])]
    globs = spark.createDataFrame([("a", "src/*"), ("b", "*.py")], "id string, glob string")
    paths = spark.createDataFrame([("src/x.py",), ("docs/y",), ("src/z",)], "path string")
    assert rows(ops.owners(paths, globs, "path")) == [("docs/y", []), ("src/x.py", ["a", "b"]), ("src/z", ["a"])]
    prefixes = spark.createDataFrame([("a", "1"), ("a/b", "2")], "prefix string, to string")
    texts = spark.createDataFrame([("a/b/c",), ("a/x",), ("ab",), (None,)], "text string")
    assert rows(ops.most_specific(texts, prefixes, "text", "prefix", "to")) == [(None, None), ("a/b/c", "2"), ("a/x", "1"), ("ab", None)]


def test_overlaps_of_a_value_that_many_share(spark, monkeypatch):
    monkeypatch.setattr(ops, "BLOCK", 4)
    own = {i: sorted({"hot", f"s{i % 3}"} if i % 5 else {f"s{i % 3}", f"t{i % 2}"}) for i in range(40)}
    m = spark.createDataFrame([("r", f"i{i:02}", s, i) for i, own_ in own.items() for s in own_], "repo string, item string, scope string, o int")
    found = ops.overlaps(m, ["repo"], "item", "scope", "o")
    assert rows(found) == sorted(("r", f"i{i:02}", f"i{j:02}", sorted(set(own[i]) & set(own[j]))) for i in own for j in own if i < j and set(own[i]) & set(own[j]))
    # Pairs are told as the join makes them: no aggregate gathers them anew.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate")


def test_the_index_of_patterns_finds_what_each_of_them_matches(spark):
    import fnmatch
    import random

    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "src", "x.y", "", "m1"])
    paths = sorted({"/".join(word() for _ in range(rng.randrange(1, 5))) + rng.choice(["", ".py", ".test.md", "[", "]x", ".p/y"]) for _ in range(400)} - {""})
    globs = sorted({"/".join(rng.choice([word(), "*", "**", "?", "[ab]", "[!a]", "m*", "*.py", "s[rq]c"]) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", "*.md", ".py", "/*", "[", "?", ".p/?"]) for _ in range(300)} - {""} | set(paths[:20]))
    found = ops.pattern_hits(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(g, g) for g in globs], "glob string, own string"), "path")
    got = {(r["path"], r["own"]) for r in found.collect()}
    assert got == {(p, g) for p in paths for g in globs if fnmatch.fnmatchcase(p, g)} and len(got) > 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_many_globs_are_not_sent_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(ops, "FEW_ROWS", 100)
    paths = spark.createDataFrame([(f"area/m{i % 7}/f{i}.py",) for i in range(300)], "path string")
    globs = spark.createDataFrame([(f"o{i % 3}", f"*/m{i % 7}/f{i}.*") for i in range(300)] + [("all", "area/*.py")] * 50, "id string, glob string")
    found = ops.owners(paths, globs, "path")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == sorted((f"area/m{i % 7}/f{i}.py", ["all", f"o{i % 3}"]) for i in range(300))
    hits = ops.pattern_hits(paths, globs, "path")
    assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()
    assert rows(hits) == sorted((f"area/m{i % 7}/f{i}.py", o) for i in range(300) for o in [f"o{i % 3}"] + ["all"] * 50)


def test_globs_that_share_a_folder_are_filed_under_their_rarest_word(spark):
    from recordloom.functions import text as t

    paths = spark.createDataFrame([(f"area/m{i % 7}/f{i}.py",) for i in range(300)], "path string")
    globs = spark.createDataFrame([(f"o{i % 3}", f"*/m{i % 7}/f{i}.*") for i in range(300)] + [("all", "area/*.py")] * 50, "id string, glob string")
    assert rows(ops.owners(paths, globs, "path")) == sorted((f"area/m{i % 7}/f{i}.py", ["all", f"o{i % 3}"]) for i in range(300))
    # Keys of folders alone would hold each path against 300 globs.
    keys = globs.distinct().select("glob", F.explode(t.glob_keys("glob")).alias("key"))
    assert keys.where("key = 'wf7'").select("glob").collect() == [("*/m0/f7.*",)]
    near = [n for n in ops.glob_hits(paths, globs, "path")._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in n]
    assert any("_key" in n and "_head" in n and "RLIKE" in n for n in near)


def test_occurrences_of_many_names(spark):
    from recordloom.operators import dictionary

    names = ["ab", "b", "abc", "é/", "x" * 50, "", None]
    texts = ["zabcab", "", None, "é/é/", "x" * 52, "none"]
    docs = spark.createDataFrame([(i, x, "own") for i, x in enumerate(texts)], "i int, text string, name2 string")
    want = {(i, n, k) for i, x in enumerate(texts) for n in names if n and x for k in range(len(x)) if x.startswith(n, k)}
    for most in (dictionary.MOST, 3):
        found = dictionary.occurrences(docs, spark.createDataFrame([(n,) for n in names + names], "name string"), "text", most)
        got = [(r["i"], r["name"], r["at"]) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want and all(r["stop"] == r["at"] + len(r["name"]) for r in found.collect())
    assert dictionary.occurrences(docs, docs.select("name2").toDF("name").limit(0), "text").count() == 0
    taken = dictionary.leftmost(found, ["i"], "at", "stop", "name")
    assert {r["i"]: r["name"] for r in taken.collect()} == {0: ["abc", "ab"], 3: ["é/"], 4: ["x" * 50]}


def edges(spark, *pairs):
    return spark.createDataFrame([("r", a, b, a, i) for i, (a, b) in enumerate(pairs)], "repo_id string, src string, dst string, src_ord string, pos int")


def test_cycles(spark):
    assert [r["cycle"] for r in graph.cycles(edges(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"))).collect()] == [["a", "b", "a"]]
    assert [r["cycle"] for r in graph.cycles(edges(spark, ("a", "a"))).collect()] == [["a", "a"]]
    assert sorted(r["cycle"] for r in graph.cycles(edges(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"))).collect()) == [["a", "b", "a"], ["a", "b", "c", "a"]]
    assert graph.cycles(edges(spark, ("a", "b"), ("b", "c"))).count() == 0


def test_components_of_cycles_against_brute_force(spark):
    import random

    rng = random.Random(7)
    pairs = {(f"{rng.choice('pq')}", a, b) for _ in range(90) for a, b in [(rng.randrange(40), rng.randrange(40))]} | {("p", 100 + i, 101 + i) for i in range(30)} | {("p", 130, 100), ("q", 7, 7), ("q", 200, 201)}
    after = {}
    for r, a, b in pairs:
        after.setdefault((r, a), set()).add((r, b))

    def reached(start):
        seen, todo = set(), list(after.get(start, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        return seen

    far = {x: reached(x) for x in after}
    want = sorted((r, n, min(b for (s, b) in far[r, n] if (r, n) in far.get((s, b), ()))) for r, n in far if (r, n) in far[r, n])
    got = graph.on_cycles(spark.createDataFrame(list(pairs), "repo_id string, src bigint, dst bigint"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 30


def test_a_scope_that_a_task_can_hold_needs_no_rounds(spark, monkeypatch):
    pairs = [("p", i, i + 1) for i in range(60)] + [("p", 60, 20), ("q", 1, 2), ("q", 2, 1), ("q", 2, 3), ("q", 5, 5), ("q", None, 1)]
    df = spark.createDataFrame(pairs, "repo_id string, src bigint, dst bigint")
    want = sorted([("p", i, 20) for i in range(20, 61)] + [("q", 1, 1), ("q", 2, 1), ("q", 5, 5)])
    with monkeypatch.context() as m:
        m.setattr(graph, "_fixpoint", None)
        assert sorted(map(tuple, graph.on_cycles(df).collect())) == want
    monkeypatch.setattr(graph, "WHOLE", 4)  # p goes through rounds
    assert sorted(map(tuple, graph.on_cycles(df).collect())) == want


def test_components_are_walked_whole_whatever_the_batches(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        pairs = [(f"{c}{i}", f"{c}{(i + 1) % 5}") for c in "abcd" for i in range(5)] + [("e", "e")]
        assert sorted(r["cycle"] for r in graph.cycles(edges(spark, *pairs)).collect()) == [[*(f"{c}{i}" for i in range(5)), f"{c}0"] for c in "abcd"] + [["e", "e"]]
    finally:
        spark.conf.set(size, before)


def test_patches(spark):
    assert patched(b"first\nsecond\n", b"--- a\n+++ b\n@@ -1,0 +2 @@\n+inserted\n") == b"first\ninserted\nsecond\n"
    assert patched(b"a\nb\nc\n", b"@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n") == b"a\nB\nc\n"
    assert patched(b"a\nb", b"--- a\n+++ b\n@@ -2 +2 @@\n-b\n\\ No newline at end of file\n+c\n") == b"a\nc\n"
    assert patched(b"a\nb\nc\nd\n", b"@@ -1 +1,2 @@ x\n a\n+A\n@@ -4 +5,0 @@\n-d\n--- next\n") == b"a\nA\nb\nc\n"
    for patch, said in ((b"nothing", "no hunk"), (b"@@ -1 +1 @@\n-x\n+y\n", "doesn't fit"), (b"@@ -2 +2 @@\n-b\n+b\n@@ -1 +1 @@\n-a\n+a\n", "before the end"), (b"@@ -1,2 +1 @@\n-a\n+y\n", "its head says"), (b"@@ -9 +9 @@\n-x\n+x\n", "doesn't fit")):
        with pytest.raises(ValueError, match=said):
            patched(b"a\nb\n", patch)
    df = spark.createDataFrame([(b"a\n", b"@@ -1 +1 @@\n-a\n+b\n"), (b"a\n", b"no"), (None, b"x")], "s binary, p binary")
    got = [r[0] for r in df.select(apply_patch("s", "p")).collect()]
    assert bytes(got[0]["content"]) == b"b\n" and "no hunk" in got[1]["error"] and got[2] == (None, None)


def test_more_names_give_no_more_passes_over_the_texts(spark):
    from recordloom.operators import dictionary

    names = spark.createDataFrame([(f"plan{i}/",) for i in range(400)] + [("é/",)], "name string")
    docs = spark.createDataFrame([(i, f"See (../plan{i}/x, aplan{i % 7}/ and é/") for i in range(300)], "i int, text string")
    found = dictionary.occurrences(docs, names, "text", 200)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # all parts, and short names
    want = [(i, n, m.start()) for i in range(300) for n in (f"plan{i}/", f"plan{i % 7}/", "é/") for m in re.finditer(re.escape(n), f"See (../plan{i}/x, aplan{i % 7}/ and é/")]
    assert rows(found, "i", "name", "at") == sorted(set(want), key=lambda r: tuple((True, str(x)) for x in r))
