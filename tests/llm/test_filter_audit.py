"""The audit against counting document by document, order by order."""

import random
from itertools import permutations

import pytest

from recordloom.llm import filter_audit

SPACE = " \t\n\v\f\r"


def fails(rows):
    """The letters that each row (doc_id, text, lang) fails."""
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        bad = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (x or "") == text for j, x, _ in rows),
        }
        out.append({k for k, v in bad.items() if v})
    return out


def brute(rows, labels):
    bad, out = fails(rows), set()
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, bad, strict=True) if (r[2] or "") == part]
        orders = ["".join(o) for o in permutations("ABCDE")]
        removed = {(o, k): [i for i, f in own if o[k] in f and not f & set(o[:k])] for o in orders for k in range(5)}
        for o in orders:
            for k in range(5):
                gone = removed[o, k]
                kept = sum(not f & set(o[: k + 1]) for _, f in own)
                redundant = sum(o[k] in f and bool(f & set(o[:k])) for _, f in own)
                shapley = sum(len(removed[p, p.index(o[k])]) for p in orders)
                out.add((part, o, k + 1, kept, len(gone), redundant, sum(f == {o[k]} for _, f in own), sum(i in good for i in gone), sum(i in toxic for i in gone), shapley))
    return out


def data(n=120, seed=3):
    rng = random.Random(seed)
    texts = [None, "", " \n", "SHOUT", "a # b", "é" * 10 + "AB", "word word " * 90, "x " * 99, "x " * 100]
    for _ in range(n):
        words = [f"w{rng.randrange(rng.choice([40, 4000]))}" for _ in range(rng.choice([20, 99, 100, 160]))]
        text = rng.choice([" ", "\n", "\t \x0b"]).join(words)
        texts.append(rng.choice([text, text.upper(), text + " 100%", text]))
    texts += rng.choices(texts, k=40)
    rows = [(rng.choice([i, i, i, i, None, i - 1]), x, rng.choice(["en", "de", None, "", "x y"])) for i, x in enumerate(texts)]
    labels = [(rng.randrange(len(texts)), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(120)] + [(None, 1, 1)]
    return rows, labels


def test_same_as_counting(spark):
    rows, labels = data()
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id bigint, text string, lang string, mask int, n int, part string")
    out = filter_audit.audit(filter_audit.labelled(filter_audit.masks(docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, labels)


def test_the_filters_of_a_text():
    assert filter_audit.text_mask(b"") == 1 and filter_audit.text_mask(b"a*b " * 100) == 0b1010
    words = " ".join(f"Word{i}" for i in range(200_000))
    assert filter_audit.text_mask(words.encode()) == (0b100 if 200_000 * 10 > len(words) else 0)
    assert filter_audit.text_mask(("É " + words.lower()).encode()) == 0


def test_no_documents_and_no_labels(spark):
    docs, labels = spark.createDataFrame([], "doc_id bigint, text string, lang string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(filter_audit.labelled(filter_audit.masks(docs), labels)).count() == 0
    one = spark.createDataFrame([(1, "a", None)], "doc_id bigint, text string, lang string")
    out = filter_audit.audit(filter_audit.labelled(filter_audit.masks(one), labels)).collect()
    assert len(out) == 600 and {r["part"] for r in out} == {""} and all(r["removed"] == (r["filter_order"][r["step"] - 1] == "A") for r in out)


def test_other_numbers_of_filters(spark):
    rows = spark.createDataFrame([("p", m % 8, m % 3) for m in range(50)], "part string, mask bigint, weight bigint")
    out = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(rows, ("weight",), "xyz").collect()}
    assert len(out) == 18 and out["zyx", 2]["removed"] == sum(m % 8 in (2, 3) for m in range(50)) and out["zyx", 2]["weight_lost"] == sum(m % 3 for m in range(50) if m % 8 in (2, 3))
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit(rows, letters="abcdefgh")
