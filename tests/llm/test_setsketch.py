"""SetSketch links against all pairs of sets, and its estimates against known similarities."""

import random
from fractions import Fraction

import numpy as np
import pytest

from recordloom.llm import linking, setsketch
from tests.llm.test_near_copies import corpus, shingles


def brute(data, share=Fraction(85, 100)):
    """doc_id: (n_shingles, component_id, kept), of rows (doc_id, text) with ids of their own."""
    sets, meets, label = [shingles(x) for _, x, *_ in data], {}, list(range(len(data)))

    def top(i):
        return i if label[i] == i else top(label[i])

    for i, own in enumerate(sets):
        shared = {}
        for x in own:
            for j in meets.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            meets[x].append(i)
        for j, n in shared.items():
            if n >= share * (len(own) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    low = {}
    for i, (key, *_) in enumerate(data):
        low[top(i)] = min(low.get(top(i), key), key)
    return {key: (len(sets[i]), low[top(i)], low[top(i)] == key) for i, (key, *_) in enumerate(data)}


def found(spark, data):
    docs = spark.createDataFrame([(i, x, 1, "y", 2) for i, x, *_ in data], "doc_id bigint, text string, n int, sketch string, component_id int")
    out = setsketch.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    return {r[0]: tuple(r)[1:] for r in out}


def chain(n, seed):
    """Texts of one base of 300 words, each with some words changed, so that near the threshold there are links of all kinds."""
    rng = random.Random(seed)
    base, out = [f"b{i}" for i in range(300)], []
    for k in range(n):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8, 10])):
            own[rng.randrange(300)] = f"c{k}-{rng.randrange(9)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("large", "block"), [(1024, 2048), (4, 8), (1 << 40, 7)])
def test_same_groups_as_all_pairs(spark, monkeypatch, large, block):
    monkeypatch.setattr(linking, "LARGE", large)
    monkeypatch.setattr(linking, "BLOCK", block)
    data = corpus(large % 97) + [(20_000 + i, x) for i, x in enumerate(chain(60, block))]
    want = brute(data)
    assert found(spark, data) == want
    assert sum(not kept for _, _, kept in want.values()) > 40


def test_ids_may_be_null_or_equal(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(None, text), (4, text), (4, text.upper()), (9, text), (None, ""), (None, None), (None, "other words"), (1, " ")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in setsketch.near_duplicates(docs).collect())
    assert got == sorted([(0, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (0, 0, 0, True), (0, 0, 0, True), (0, 1, 0, True), (1, 0, 1, True)])
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    long = [f"w{i}" for i in range(120_000)]
    data = [(1, " ".join(long)), (2, " ".join(long[:-9000])), (3, " ".join(long[:-40_000])), (4, "short")]
    assert found(spark, data) == {1: (119_996, 1, True), 2: (110_996, 1, False), 3: (79_996, 3, True), 4: (1, 4, True)}


@pytest.mark.parametrize("similarity", [0.5, 0.85, 0.95])
@pytest.mark.parametrize(("n", "times"), [(200, 1), (3000, 1), (300, 2)])
def test_estimates(similarity, n, times):
    rng, out, share = np.random.default_rng(7), [], []
    for _ in range(60):
        m = n * times  # the greater set holds `times` as many
        same = min(n, round((n + m) * similarity / (1 + similarity)))
        own = rng.integers(0, 1 << 63, n + m - same).astype(np.uint64)
        a, b = setsketch.sketch(own[:n]), setsketch.sketch(own[n - same :])
        share.append(same / (n + m - same))
        out.append(setsketch.estimate(a[None], b[None], np.array([n]), np.array([m]), 0.85))
        assert (setsketch.merge(a, b) == setsketch.sketch(own)).all()
    assert abs(np.mean([x[0][0] for x in out]) - np.mean(share)) < 0.03
    ratios = [x[1][0] for x in out]
    if times == 2 or similarity == 0.5:
        assert min(ratios) > setsketch.DOUBT
    else:
        assert max(ratios) < setsketch.DOUBT


def test_a_key_of_many_unlike_rows_makes_no_pairs(spark, monkeypatch):
    """3,000 rows share a key and no sketch allows a link: none leaves a task, though all pairs are held against each other."""
    n, seen = 3000, []
    entries = spark.range(n).selectExpr("1L AS h", "id AS row", "0L AS place")
    nodes = spark.range(n).selectExpr("id AS row", "cast(cast(id AS string) AS binary) AS raw").selectExpr("row", "substring(sha2(raw, 256), 1, 16) AS text").selectExpr("row", "cast(text AS binary) AS sketch")

    def verify(pairs):
        seen.append(pairs.count())
        return linking.written(pairs.where("a < 0"), "none")

    possible = lambda place, one, places, others: np.zeros(len(others), bool)
    assert linking.linked(entries, nodes, possible, verify).count() == 0
    assert seen == [n - 1, 0, 0]
