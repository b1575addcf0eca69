"""Conversation repair against a brute-force search that carries whole strings of edits."""

import hashlib
import random
import zlib
from itertools import pairwise

import pytest

from recordloom.llm import turn_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE, COLUMNS = " \t\n\v\f\r", ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """(cost, edits, repaired lines), least first by cost and then by ASCII, over all ways, state by state."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, edits, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if to := follow.get((state, role[0])):
                        best[to] = min(best.get(to, (1 << 40,)), (cost + 5, edits + "I", (*lines, f"{role}:")))
        return best

    best = inserted({"": (0, "", ())})
    for fault, role, text in turns:
        new, late = {}, 5 * (fault == "truncated")
        for state, (cost, edits, lines) in best.items():
            options = [(state, cost + 2, "D", ())]
            if fault not in ("blank", "duplicate"):
                options += [(follow.get((state, role[:1])), cost + late, "K", (f"{role}:{text}",))]
                options += [(follow.get((state, r[0])), cost + late + 1, "R", (f"{r}:{text}",)) for r in ("user", "assistant")]
            for to, c, letter, line in options:
                if to is not None:
                    new[to] = min(new.get(to, (1 << 40,)), (c, edits + letter, lines + line))
        best = inserted(new)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in damaged(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text in own:
            said = text.strip(SPACE)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            turns.append((fault, role, text))
        cost, edits, lines = cheapest(turns)
        known = [r[0] for r in own if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(own))
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(n, seed=5, most=9):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        turns = [(t, rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool", "User", "unit"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]) for t in range(rng.randrange(1, most))]
        for t, role in turns:
            text = rng.choice(["Yes.", "No!", "what is it", " \t\n", "", None, "Ends here. \n", "é ü?", "x" * 50, f"turn {t} of {conv}."])
            if rng.random() < 0.9:
                rows.append((conv, rng.choice([t, t, t, t, None, t + 7]), role, text))
        if rng.random() < 0.2 and rows:
            rows.append(rng.choice(rows[-3:]))
    rng.shuffle(rows)
    return rows


def repaired(spark, rows, most=turn_repair.PIECE_BYTES, parts=4):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = turn_repair.summary(turn_repair.repair(turn_repair.damage(spark.createDataFrame(rows, SCHEMA)), most))
        assert sorted(out.columns) == sorted(COLUMNS)
        got = [tuple(r) for r in out.select(COLUMNS).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


@pytest.mark.parametrize(("most", "parts"), [(turn_repair.PIECE_BYTES, 4), (1, 3), (200, 7)])
def test_same_as_brute_force(spark, most, parts):
    rows = conversations(150, seed=most % 1000 + parts)
    want = brute(rows)
    assert repaired(spark, rows, most, parts) == want
    assert sum("R" in x[6] for x in want.values()) > 20 and any(x[6] == "" for x in want.values())


def test_insertions(monkeypatch):
    """At their price they never pay, so they are tried at others."""
    go = turn_repair.costs_to_go([], turn_repair.END)
    assert turn_repair.walk([], go, turn_repair.SYSTEM, True) == ("II", [(None, turn_repair.USER), (None, turn_repair.ASSISTANT)], turn_repair.ASSISTANT)
    own = turn_repair._Turns([(0, "system", "Be kind.", 1, False), (1, "assistant", "Yes.", 1, False), (2, "assistant", "No.", 2, False)])
    monkeypatch.setattr(turn_repair, "REROLE", 99), monkeypatch.setattr(turn_repair, "DELETE", 9)
    out = own.repaired()
    assert (out["edits"], [x["role"] for x in out["turns"]]) == ("KIKIKD", ["system", "user", "assistant", "user", "assistant"])


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(7, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "system", rng.choice(["Same.", f"Turn {t}.", "cut"])) for t in range(3000)] + [(7, 9, "user", "Often.")] * 500 + conversations(3)
    assert repaired(spark, rows, 20_000, 8) == brute(rows)


def test_nothing_left_and_nothing_there(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert repaired(spark, [(1, gone, "user", "Gone.")]) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = spark.createDataFrame([], SCHEMA + ", part string, cost long")
    assert turn_repair.summary(turn_repair.repair(turn_repair.damage(empty))).count() == 0


def test_very_long_texts_and_columns_with_clashing_names(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "word " * 400_000), (1, 2, "assistant", "Short.")]
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA + ", n int, key string, `a.b` int, edits int")
    out = turn_repair.summary(turn_repair.repair(turn_repair.damage(docs), 1000)).select(COLUMNS).collect()
    assert {r[0]: tuple(r)[1:] for r in out} == brute(rows)


def test_any_kind_of_id(spark):
    rows = [("a:1", 0, "user", "Hi."), (None, 0, "user", "Hi."), ("", 1, "assistant", "Oh.")]
    out = turn_repair.summary(turn_repair.repair(spark.createDataFrame(rows, SCHEMA.replace("conv_id bigint", "conv_id string")))).collect()
    assert {r["conv_id"]: r["audit"] for r in out} == {"a:1": "D", None: "D", "": "D"}
