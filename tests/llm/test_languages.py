"""Language models against enumerated segmentations, long words, unseen letters and texts in no language."""

import math
from itertools import product

import numpy as np
import pytest

from recordloom.llm import language_id as L

PIECES = {p: i + 1 for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "abba", "bab"])}


def segmentations(w):
    for cuts in product([0, 1], repeat=len(w) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(w)]
        own = [w[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        ids = [PIECES.get(x, 0 if len(x) == 1 else None) for x in own]
        if None not in ids:
            yield ids


@pytest.mark.parametrize("scaled", [2, 3, 8])
def test_probabilities_and_expected_counts_are_those_of_all_segmentations(monkeypatch, scaled):
    monkeypatch.setattr(L, "SCALED", scaled)
    p, known = np.random.default_rng(5).random(len(PIECES) + 1), L.Pieces(PIECES)
    for own, times in ((["▁abbab", "▁bxbba", "▁ababx"], [2.0, 1.0, 5.0]), (["▁"], [1.0]), (["▁abbababbaba"], [3.0])):
        want_logs, want = [], np.zeros(len(p))
        for w, n in zip(own, times, strict=True):
            each = [(math.prod(p[i] for i in ids), ids) for ids in segmentations(w)]
            whole = sum(x for x, _ in each)
            want_logs.append(math.log(whole))
            for x, ids in each:
                np.add.at(want, ids, n * x / whole)
        lattice, got = L.Lattices(own, known), np.zeros(len(p))
        assert lattice.logs(lambda ids, _: p[ids]) == pytest.approx(want_logs)
        lattice.expected(lambda ids, _: p[ids], np.array(times), lambda ids, rows, x: np.add.at(got, ids, x))
        assert got == pytest.approx(want)


def test_nothing_is_lost_below_the_smallest_number():
    p = np.full((len(PIECES) + 1, 2), 1e-30)
    p[0, 1] = 2e-30
    model = L.Model(["x", "y"], p, L.Pieces(PIECES))
    a, b = model.logs(["▁" + "é" * 40, "▁" + "é" * 255])
    assert a == pytest.approx([math.log(1e-30) * 41, math.log(2e-30) * 40 + math.log(1e-30)]) and b[1] - b[0] == pytest.approx(255 * math.log(2))


def test_unseen_pieces_stay_as_likely_however_much_is_learned():
    counts = np.zeros((200, 2))
    counts[:100, 0] = counts[50:150, 1] = 10.0
    small, large = L._smoothed(counts), L._smoothed(counts * 1e8)
    assert small == pytest.approx(large) and small.sum(0) == pytest.approx([1, 1]) and small.min() > 0


def test_long_runs_are_chains_without_false_starts():
    own = L.words("ab " + "a" * 600 + " b")
    assert own == ["▁ab", "▁" + "a" * 256, "a" * 256, "a" * 88, "▁b"] and L.words("Ab c") == ["▁ab", "▁c"]


@pytest.fixture(scope="module")
def learned(spark):
    said = {"en": "the house and the garden with this thing that was there when they came", "de": "das haus und der garten mit dem ding das dort stand als sie kamen"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(x.split(), 30)), lang) for i in range(60) for lang, x in said.items()]
    return L.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_texts_in_no_language_go_and_lettered_ones_stay_where_nothing_is_known(spark, learned):
    texts = {1: "the garden and the house that was there " * 4, 2: "xqzkv wqxz jjqx zzkq vvxq qqzx kxqz zxvq " * 4, 3: "日本語 " * 30, 4: "12 34", 5: None, 6: "das ding im garten und das haus " * 5, 7: "ж" * 3000}
    docs = spark.createDataFrame([(i, x, "k") for i, x in texts.items()], "doc_id bigint, text string, lang_pred string")
    assert sorted(r["doc_id"] for r in L.keep(docs, learned).collect()) == [1, 6]
    nothing = L.train(docs.selectExpr("text", "cast(null as string) as lang"))
    assert sorted(r["doc_id"] for r in L.keep(docs, nothing).collect()) == [1, 2, 3, 6, 7]


def test_a_forgetful_table_gives_the_same_scores(monkeypatch, learned):
    texts = ["the garden und das haus", "was there " * 3, "als sie kamen the", None, "ä" * 700]
    whole = L._judge(L._Scores(learned), texts)
    monkeypatch.setattr(L, "REMEMBERED", 4)
    scores = L._Scores(learned)
    each = [L._judge(scores, [x]) for x in texts + texts]
    assert [e[0][0] for e in each] == whole[0] * 2 and [e[1][0] for e in each] == pytest.approx(list(whole[1]) * 2)
