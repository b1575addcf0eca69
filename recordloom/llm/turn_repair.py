"""Conversation structure repair: the cheapest edits after which the roles of a conversation alternate as they must.

The roles' initials have to read (s?(ua)+)?, a grammar of four states. From the last turn back, the cost-to-go of each state
is the least of the turn's edits (keep, rerole, delete) and of a turn inserted before it; then a walk from the first turn on
takes, of the edits whose cost is just what is to go (cost-tight), the one whose letter comes first in ASCII. A state allows
one role alone for an inserted or changed turn, so the letters tell all.

Conversations are partitioned by ranges of (conversation, turn), not by conversation, so one that holds a third of all rows
is spread over many tasks. A task handles the conversations that lie between the first and the last of its range. Those two
may go on in other ranges, so they are pieces: the costs of a piece are a (min, +) matrix over the states, and the matrices
of a conversation's pieces, multiplied from the last one back, tell each piece what is to go at its end; then the states in
which a piece leaves for each that it is entered in, composed from the first one on, tell where its walk starts. Two pieces
for each range at most pass through the driver, as numbers of 16 states. Equal rows are one row with a count before
anything else.

Cases: a null conversation is one of its own; a null role or text is one space (so such a text is blank); null turns come
first; rows of the same turn go by role and then by text, which puts equal ones side by side; a very long text is handled
whole; a conversation without a turn gives one piece without turns; an empty table gives an empty one; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import written

#: States: at the start, after a system turn, after a user's, after an assistant's; the role that each allows to be made.
START, SYSTEM, USER, ASSISTANT = range(4)
_MADE = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state that a turn which stays leads to, by state and initial.
_STAYS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What an edit costs, and a turn that stays though it is cut short.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_PRICE = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
FAR = 1 << 60
_LEGAL = ("su", "ua", "au")
_SPACE, _ENDS = " \t\n\v\f\r", (".", "!", "?")
#: Costs at the end, where the grammar accepts the start and an assistant's turn.
END = (0, 2 * INSERT, INSERT, 0)

#: Bytes of text in a piece, about, and at most but for one turn's.
PIECE_BYTES = 64 << 20

_TURNS = "array<struct<role:string,text:string>>"
_PIECE = f"piece bigint, alone boolean, first_turn bigint, last_turn bigint, n_turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, edits string, turns {_TURNS}"
_ROWS = "array<struct<turn:bigint,role:string,text:string,n:bigint,copy:boolean>>"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of `conv_id:turn` modulo 20: 0 is gone (role, text and turn are null), 1 has an
    empty text, 2 no `.`, `!` or `?`, 3 stands twice, 4 has the role user. Null strings and ids are one space, null turns stay.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    here = lambda x: F.when(F.col("kind") != 0, x)
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", here(F.col("turn")).alias("turn"), here(F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"),
        here(F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time"),
    ).drop("time")


def fault(text: str, copy: bool) -> str:
    """Of a turn: blank, duplicate, truncated, or nothing."""
    said = text.rstrip(_SPACE)
    return "blank" if not said else "duplicate" if copy else "" if said.endswith(_ENDS) else "truncated"


def _edits(row: tuple, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of the edits of a turn (faulty, initial, truncated), in the order of ASCII; all consume it."""
    gone, initial, cut = row
    yield "D", DELETE, state
    if not gone:
        if (state, initial) in _STAYS:
            yield "K", TRUNCATED * cut, _STAYS[state, initial]
        yield "R", REROLE + TRUNCATED * cut, _MADE[state]


def costs_to_go(rows: list[tuple], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each place before a turn, and the end: what the rest costs from each state. rows: (must go, initial, truncated)."""
    out = [end]
    for row in reversed(rows):
        ahead = out[-1]
        own = [min(cost + ahead[to] for _, cost, to in _edits(row, state)) for state in range(4)]
        for _ in range(2):  # two insertions lead back to where they began
            own = [min(own[s], INSERT + own[_MADE[s]]) for s in range(4)]
        out.append(tuple(min(x, FAR) for x in own))
    return out[::-1]


def walk(rows: list[tuple], ahead: list[tuple[int, ...]], state: int, closing: bool) -> tuple[str, list[tuple[int | None, int | None]], int]:
    """Letters, the turns that result (place in rows or None, role made or None) and the state at the end of the cheapest edits."""
    letters, made, k = [], [], 0
    while True:
        over = k == len(rows)
        if over and not (closing and ahead[k][state]):
            return "".join(letters), made, state
        options = [] if over else [(letter, ahead[k + 1][to] + cost, to, 1) for letter, cost, to in _edits(rows[k], state)]
        options.append(("I", ahead[k][_MADE[state]] + INSERT, _MADE[state], 0))
        letter, _, state, used = min(x for x in options if x[1] == ahead[k][state])
        letters.append(letter)
        if letter != "D":
            made.append((k if used else None, None if letter == "K" else state))
        k += used


class _Turns:
    """The turns of a piece, of rows (turn, role, text, n, copy): steps of the grammar, how often each stands, counts of faults."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.kept, self.counts = rows, [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal, last = 0, None
        for _, role, text, n, copy in rows:
            for what, times in ((fault(text, copy), 1), ("duplicate" if text.rstrip(_SPACE) else "blank", n - 1)):
                self.counts[what] += times
                if times:
                    self.kept.append(((what in ("blank", "duplicate"), role[:1], what == "truncated"), role, text, times))
            self.illegal += (n - 1) + (last is not None and last + role[:1] not in _LEGAL)
            last = role[:1]
        self.steps = [x[0] for x in self.kept]

    def matrix(self) -> list[int]:
        """The least cost from each state at the start to each at the end, by rows."""
        columns = [costs_to_go(self.steps, tuple(0 if s == k else FAR for s in range(4)))[0] for k in range(4)]
        return [columns[k][s] for s in range(4) for k in range(4)]

    def repaired(self, end: tuple[int, ...] = END, state: int = START, closing: bool = True, before: tuple = (None, None)) -> dict:
        """The columns of a piece that is entered in a state, with the last turn and role's initial of the pieces before it.

        A run of copies is one step to the grammar, for all of them are deleted at one place.
        """
        letters, made, _ = walk(self.steps, costs_to_go(self.steps, end), state, closing)
        edits, at, cost = [], 0, TRUNCATED * sum(i is not None and self.steps[i][2] for i, _ in made)
        for letter in letters:
            times = 1
            if letter != "I":
                times, at = self.kept[at][3], at + 1
            edits.append(letter * times)
            cost += _PRICE[letter] * times
        numbers, head = [r[0] for r in self.rows if r[0] is not None], self.rows[0][1][:1] if self.rows else None
        seam = before[1] is not None and head is not None and before[1] + head not in _LEGAL
        return {
            "first_turn": min(numbers, default=None), "last_turn": max(numbers, default=None), "n_turns": len(set(numbers)) - (numbers[:1] == [before[0]]),
            "blank": self.counts["blank"], "duplicate": self.counts["duplicate"], "truncated": self.counts["truncated"], "illegal": self.illegal + seam, "cost": cost, "edits": "".join(edits),
            "turns": [{"role": self.kept[i][1] if role is None else _ROLE[role], "text": "" if i is None else self.kept[i][2]} for i, role in made],
        }

    def ends(self) -> tuple:
        """The last turn and the last role's initial, or None."""
        return next((r[0] for r in reversed(self.rows) if r[0] is not None), None), self.rows[-1][1][:1] if self.rows else None


def _ordered(turns: DataFrame) -> DataFrame:
    """Distinct rows with their count n and whether role and text came before (copy), in ranges of (conv_id, turn)."""
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.when(F.col("conv_id").isNull(), -1).otherwise(F.length(conv)).cast("string"), F.length("role").cast("string"), conv, "role", "text").cast("binary"))
    rows = written(rows.withColumn("key", F.when(F.col("role").isNotNull(), key)), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = written(rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("m"), F.min(order).alias("first")).where("m > 1"), "again")
    # The few keys of very many rows are looked up apart; their rows go to the other join by keys that nothing has.
    bound = (again.agg(F.sum("m")).first()[0] or 0) / 1000
    rows = rows.join(F.broadcast(again.where(F.col("m") > bound).select("key", F.col("first").alias("hot"))), "key", "left")
    rows = rows.withColumn("other", F.when(F.col("hot").isNull() & F.col("key").isNotNull(), F.col("key")).otherwise(F.concat_ws("-", F.lit(""), "conv_id", "turn")))
    rows = rows.join(again.where(F.col("m") <= bound).select(F.col("key").alias("other"), "first"), "other", "left")
    rows = rows.select("conv_id", "turn", "role", "text", "n", F.coalesce(order > F.coalesce("hot", "first"), F.lit(False)).alias("copy"))
    # The driver samples the bounds of the ranges, so they hold the start of a text only.
    return rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")


def repair(turns: DataFrame, most: int = PIECE_BYTES) -> DataFrame:
    """Pieces of each conversation of turns (conv_id, turn, role, text); one, which is alone, unless it spans ranges or `most` bytes.

    piece orders them; n_turns (distinct ones that no piece before has), the counts of faults and of illegal neighbours, cost,
    edits (letters) and turns (role and text of the repaired ones) add up to those of the conversation. A row whose role is
    null only says that its conversation exists.
    """
    spark, kind = turns.sparkSession, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}"
    out, found = StructType.fromDDL(f"{kind}, {_PIECE}"), StructType.fromDDL(f"{kind}, {_PIECE}, rows {_ROWS}")
    arrow_out, arrow_found = to_arrow_schema(out), to_arrow_schema(found)

    def inner(batches):
        """Whole conversations; the rows of the first and the last one, and of those that are too long."""
        held, size, k, open_, seen = [], 0, 0, True, 0

        def emit(whole):
            key = {"conv_id": held[0][0], "piece": (held[0][6] << 32) + k}
            rows = [r[1:6] for r in held if r[2] is not None]
            if whole:
                return {**key, "alone": True, **_Turns(rows).repaired()}
            return {**key, "rows": [dict(zip(("turn", "role", "text", "n", "copy"), r, strict=True)) for r in rows]}

        for batch in batches:
            done = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = bool(held) and held[0][0] != r[0]
                if other or size > most:
                    done.append(emit(other and not open_))
                    held, size, k, open_ = [], 0, k + 1, not other
                held.append(r)
                size += len(r[3] or "") + 64
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow_found)
        if held:
            yield pa.RecordBatch.from_pylist([emit(False)], arrow_found)

    numbered = _ordered(turns).withColumn("part", F.spark_partition_id().cast("bigint"))
    pieces = written(numbered.mapInArrow(inner, found), "pieces")
    parts = pieces.where("rows IS NOT NULL").select("conv_id", "piece", "rows")

    def of_parts(make, schema: str) -> DataFrame:
        """make((conv_id, piece), turns) of each part gives its further columns."""
        schema = StructType.fromDDL(f"{kind}, piece bigint, {schema}")
        arrow = to_arrow_schema(schema)

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    conv, piece, rows = (c[0].as_py() for c in batch.slice(i, 1).columns)
                    yield pa.RecordBatch.from_pylist([{"conv_id": conv, "piece": piece, **make((conv, piece), _Turns([tuple(r.values()) for r in rows]))}], arrow)

        return parts.mapInArrow(run, schema)

    def matrix(key, own):
        last, tail = own.ends()
        return {"matrix": own.matrix(), "last": last, "tail": tail}

    # Two of each range at most, but for those over `most` bytes: numbers only.
    known = _by_conversation(of_parts(matrix, "matrix array<bigint>, last bigint, tail string").collect())
    ahead, alone, closing, before = {}, set(), set(), {}
    for own in known:
        to_go, came = END, (None, None)
        for r in reversed(own):
            ahead[r[0], r[1]] = to_go
            to_go = tuple(min(r[2][4 * s + k] + to_go[k] for k in range(4)) for s in range(4))
        for r in own:
            before[r[0], r[1]] = came
            came = (came[0] if r[3] is None else r[3], came[1] if r[4] is None else r[4])
        closing.add((own[-1][0], own[-1][1]))
        alone |= {(r[0], r[1]) for r in own if len(own) == 1}
    told = spark.sparkContext.broadcast((ahead, alone, closing, before))

    def leaves(key, own):
        to_go = costs_to_go(own.steps, told.value[0][key])
        return {"leaves": [walk(own.steps, to_go, s, False)[2] for s in range(4)]}

    entered = {}
    for own in _by_conversation(of_parts(leaves, "leaves array<bigint>").collect() if len(alone) < len(ahead) else []):
        state = START
        for r in own:
            entered[r[0], r[1]] = state
            state = r[2][state]
    starts = spark.sparkContext.broadcast(entered)

    def close(key, own):
        ahead, alone, closing, before = told.value
        return {"alone": key in alone, **own.repaired(ahead[key], starts.value.get(key, START), key in closing, before[key])}

    return pieces.where("rows IS NULL").select(out.names).unionByName(of_parts(close, _PIECE.removeprefix("piece bigint, ")))


def _by_conversation(rows: list) -> list[list]:
    """Rows of (conv_id, piece, ...) as a list for each conversation, in the order of the pieces."""
    rows.sort(key=lambda r: (r[0] is not None, str(r[0]), r[1]))
    return [list(own) for _, own in groupby(rows, itemgetter(0))]


def summary(pieces: DataFrame) -> DataFrame:
    """A row for each conversation: gaps, counts of faults, illegal neighbours, cost, audit (all edits) and repaired_sha256.

    Conversations of several pieces are hashed by a task that reads them in order and holds one batch of them.
    """
    counts, kind = ("blank", "duplicate", "truncated", "illegal", "cost"), pieces.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = lambda last, first, n: F.coalesce(last - first + 1 - n, F.lit(0).cast("bigint")).alias("gaps")
    own = pieces.where("alone").select("conv_id", gaps(F.col("last_turn"), F.col("first_turn"), F.col("n_turns")), *counts, F.col("edits").alias("audit"), F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))

    def hashed(batches):
        at, sha, some = None, None, False
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                conv, _, text, n = (c[0].as_py() for c in batch.slice(i, 1).columns)
                if at != (conv,):
                    if at:
                        done.append({"conv_id": at[0], "repaired_sha256": sha.hexdigest()})
                    at, sha, some = (conv,), hashlib.sha256(), False
                if n:
                    sha.update(("\n" * some + text).encode())
                    some = True
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
        if at:
            yield pa.RecordBatch.from_pylist([{"conv_id": at[0], "repaired_sha256": sha.hexdigest()}], arrow)

    schema = StructType.fromDDL(f"conv_id {kind}, repaired_sha256 string")
    arrow = to_arrow_schema(schema)
    rest = pieces.where("NOT alone")
    digests = rest.select("conv_id", "piece", lines.alias("text"), F.size("turns").alias("n")).repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(hashed, schema)
    edits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "edits"))), lambda x: x["edits"]), "")
    sums = rest.groupBy("conv_id").agg(gaps(F.max("last_turn"), F.min("first_turn"), F.sum("n_turns")), *(F.sum(c).alias(c) for c in counts), edits.alias("audit"))
    joined = sums.withColumnRenamed("conv_id", "id").join(digests, F.col("id").eqNullSafe(F.col("conv_id"))).select(own.columns)
    return own.unionByName(joined)
