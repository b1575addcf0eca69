"""Near copies against all pairs of texts, compared by brute force."""

import random
import re
from itertools import combinations

import pytest

import corpus_pipeline
from recordloom.llm import near_copies

SCHEMA = "doc_id bigint, text string, kept string"


def shingles(x):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def groups(data, share=(4, 5)):
    """The rows (by place) that stay: of each component of pairs the one of the smallest id, null last, then the first."""
    sets, label = [shingles(r[1]) for r in data], list(range(len(data)))

    def top(i):
        return i if label[i] == i else top(label[i])

    for i, j in combinations(range(len(data)), 2):
        if len(sets[i] & sets[j]) * share[1] >= share[0] * len(sets[i] | sets[j]) and bool(sets[i]) == bool(sets[j]):
            label[top(i)] = top(j)
    out = {}
    for i in range(len(data)):
        key = (data[i][0] is None, data[i][0] or 0, i)
        out[top(i)] = min(out.get(top(i), key), key)
    return out.values()


def corpus(seed=1):
    rng = random.Random(seed)
    line = "this line stands in very many of the texts and tells nothing of them".split()
    data = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(rng.randrange(1, 5)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            data.append(" ".join(own + line * rng.randrange(2)))
    data += [None, "", " ", data[0], data[0].upper()]
    rng.shuffle(data)
    ids = rng.sample(range(10_000), len(data))
    return [(i, x, "k") for i, x in zip(ids, data, strict=True)]


@pytest.mark.parametrize("stored", [True, False])
def test_one_of_each_group_stays(spark, tmp_path, monkeypatch, stored):
    monkeypatch.setattr(near_copies, "LARGE", 1024 if stored else 2)
    monkeypatch.setattr(near_copies, "BLOCK", 2048 if stored else 8)
    data = corpus(2 + stored)
    want = sorted(i for _, i, _ in groups(data))
    docs = spark.createDataFrame(data, SCHEMA)
    if stored:
        docs.repartition(3).write.parquet(f"file://{tmp_path}/docs")
        docs = spark.read.parquet(f"file://{tmp_path}/docs")
    out = near_copies.keep_one(docs)
    assert out.columns == ["doc_id", "text", "kept"] and sorted(r[0] for r in out.collect()) == want
    assert len(want) < len({x for _, x, _ in data}) - 10
    assert near_copies.keep_one(out.limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [0, 1])
def test_what_no_round_has_linked_is_compared_after_them(spark, monkeypatch, rounds):
    for name, value in (("ROUNDS", rounds), ("LARGE", 2), ("BLOCK", 4)):
        monkeypatch.setattr(near_copies, name, value)
    data = corpus(5)
    out = near_copies.keep_one(spark.createDataFrame(data, SCHEMA))
    assert sorted(r[0] for r in out.collect()) == sorted(i for _, i, _ in groups(data))


def test_sets_go_to_python_in_small_batches(spark, monkeypatch):
    size, seen, inner = "spark.sql.execution.arrow.maxBytesPerBatch", [], near_copies.written
    before = spark.conf.get(size)
    monkeypatch.setattr(near_copies, "written", lambda df, name: seen.append(int(spark.conf.get(size))) or inner(df, name))
    assert near_copies.keep_one(spark.createDataFrame(corpus(6)[:40], SCHEMA)).count() > 1
    assert len(seen) > 5 and max(seen) <= 16 << 20 and spark.conf.get(size) == before


def test_the_stage_links_at_four_fifths(spark):
    own = [f"word{i}" for i in range(104)]  # 100 shingles; a changed word in the middle changes five, one at the end one
    ends = lambda k: " ".join(own[: 104 - k] + [f"z{i}" for i in range(k)])
    data = [(1, ends(0), "k"), (2, ends(11), "k"), (3, " ".join(own[:50] + ["x"] + own[51:]), "k"), (4, ends(40), "k")]
    docs = spark.createDataFrame(data, SCHEMA)  # 2: 89 of 111 shared; 3: 95 of 105; 4: 60 of 140
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 4]
    docs = spark.createDataFrame([data[0], (2, ends(12), "k")], SCHEMA)  # 88 of 112
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 2]


def test_rows_are_told_apart_where_ids_are_equal_or_null(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    data = [(1, one, "k"), (1, two, "k"), (0, one, "k"), (None, three, "k"), (None, three, "k"), (None, two, "k")]
    got = [(r["doc_id"], r["text"]) for r in near_copies.keep_one(spark.createDataFrame(data, SCHEMA)).collect()]
    assert len(got) == 3 and set(got) == {(0, one), (1, two), (None, three)}


def test_columns_of_any_name_are_kept(spark):
    names = ["doc_id", "text", "row", "file", "at", "set", "h", "met", "bucket", "component", "kept", "_metadata", "fp", "open", "node", "best"]
    text = " ".join(f"t{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text + (" end" if i == 3 else "") if i != 2 else "other words", *(f"{n}{i}" for n in names[2:])) for i in range(4)], ", ".join(f"`{n}` {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    out = near_copies.keep_one(docs)
    assert out.columns == names and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.where("doc_id in (0, 2)").collect()))


def test_a_large_group_is_linked_by_few_comparisons(spark, monkeypatch):
    base = [f"b{i}" for i in range(120)]
    data = [(i, " ".join([*base[:60], f"x{i}", *base[60:]]), "k") for i in range(150)]
    seen, inner = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *rest: seen.append(pairs.count()) or inner(pairs, *rest))
    assert [r["doc_id"] for r in near_copies.keep_one(spark.createDataFrame(data, SCHEMA)).collect()] == [0]
    assert sum(seen) < 3 * len(data)
