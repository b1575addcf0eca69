"""Identity and references over a stream of record files: a problem is told when it is seen and taken back when it is none any more.

events() makes of each file what it says about ids: it bears one, refers to one, or rests on one. changes() groups these by
repository and id, and keeps for each id what the rules need: the files that bear it, the references that still wait for
it, its level of provenance and the items that rest on it. Each row of changes() adds a problem (change 1) or takes one
back (-1), so the sum over all rows, settled(), is what the rules of a batch say, in whatever order files arrive:

W1 duplicate ids of work items (the first one is named) and of evidence (the one before it is named), J1 dependencies and J5
work items of evidence that no sound manifest bears, N8 provisional items that rest on nothing provisional (ratcheted()).

A file is told once: records that are changed or deleted later ask for a new run. Files that can't be parsed say nothing
here (streaming.records tells them), so a repository with one is to be judged by the batch rules. A reference is held until
its target comes and no longer; what is kept for an id is streamed, not gathered, when it is needed.

The state store must be RocksDB's: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recordloom import model

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "repo_id string, kind string, id string, what string, path string, ord string, rule_id string, message string, subject string"
CHANGE = "repo_id string, path string, message string, rule_id string, subject string, change int"
#: Rows of changes() that ratcheted() needs: provisional items, and what soft evidence they rest on.
_ITEM, _SOFT = "N8 item", "N8 soft"


def events(files: DataFrame) -> DataFrame:
    """What files (repo_id, path, text; a stream or a table) say of ids, as EVENT."""
    place = rf"^work/({'|'.join(model.STATUSES)})/[^/]+/work-item\.json\z"
    rows = files.where(F.col("path").rlike(place) | F.col("path").rlike(r"^evidence/runs/[^/]+\.json\z")).select("repo_id", "path", "text", F.json_object_keys("text").alias("keys"))
    rows = rows.where("keys IS NOT NULL").select("*", F.from_json("text", model.WORK_ITEM).alias("item"), F.from_json("text", model.EVIDENCE).alias("run"), F.startswith("path", F.lit("work/")).alias("is_item"))
    lacks = lambda fields: F.size(F.array_except(F.array(*map(F.lit, fields)), "keys")) > 0
    said = lambda kind, id_, what, ord_=None, rule=None, message=None, subject=None: F.struct(*(
        (x if x is not None else F.lit(None)).cast("string").alias(n) for n, x in zip(("kind", "id", "what", "ord", "rule_id", "message", "subject"), (F.lit(kind), id_, F.lit(what), ord_, rule and F.lit(rule), message, subject), strict=True)))
    item, run = F.coalesce("item.id", F.lit("")), F.coalesce("run.id", F.lit(""))
    whole_item = ~lacks(model.WORK_FIELDS)
    ord_ = F.concat(F.array_position(F.array(*map(F.lit, model.STATUSES)), F.regexp_extract("path", place, 1)).cast("string"), F.lit("/"), "path")
    told = lambda what, x: F.concat(F.lit(f"unknown {what} '"), F.coalesce(x, F.lit("None")), F.lit("'"))
    none = F.array().cast("array<string>")
    linked = F.flatten(F.transform(F.filter("item.acceptance_criteria", lambda c: c["state"] == "satisfied"), lambda c: F.coalesce(c["evidence"], none)))
    provisional = F.col("item.provenance") == "provisional"
    of_item = F.concat(
        F.array(F.when(whole_item & item.rlike(r"^[0-9]{3,}\z"), said("work", item, "first", ord_, "W1", None, item)), F.when(provisional, said("item", F.col("path"), "item", None, _ITEM, None, item))),
        F.transform(F.coalesce("item.depends_on", none), lambda x: said("work", x, "refers", None, "J1", told("dependency", x), item)),
        F.transform(F.when(whole_item & provisional, F.array_distinct(F.coalesce(linked, none))).otherwise(none), lambda x: said("evidence", x, "rests", None, _SOFT, x)),
    )
    work = F.coalesce("run.work_item", F.lit("None"))
    of_run = F.array(
        F.when(~lacks(model.EVIDENCE_FIELDS), said("evidence", run, "before", F.col("path"), "W1", None, run)), F.when(~lacks(model.EVIDENCE_FIELDS), said("work", work, "refers", None, "J5", told("work_item", work), run)),
        F.when(F.col("run.id").isNotNull(), said("evidence", run, "level", F.col("path"), None, F.coalesce("run.provenance", F.lit("concrete")))),
    )
    out = rows.select("repo_id", "path", F.explode(F.array_compact(F.when(F.col("is_item"), of_item).otherwise(of_run))).alias("e"))
    return out.select("repo_id", "e.kind", "e.id", "e.what", "path", "e.ord", "e.rule_id", "e.message", "e.subject")


class Ids(StatefulProcessor):
    """What is known of one id of a repository."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bearers = handle.getMapState("bearers", "ord string", "path string, subject string")
        self.first = handle.getValueState("first", "ord string, path string")
        self.waiting = handle.getListState("waiting", "path string, rule_id string, message string, subject string")
        self.resting = handle.getListState("resting", "path string")
        self.level = handle.getValueState("level", "ord string, level string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        repo, kind, name = key

        def row(path, message, rule, subject, change):
            return Row(repo_id=repo, path=path, message=message, rule_id=rule, subject=subject, change=change)

        def twice(path, subject, other, change):
            return row(path, f"duplicate {'evidence ' if kind == 'evidence' else ''}id also used by {other}", "W1", subject, change)

        for r in rows:
            if r.what == "item":
                yield row(r.path, r.message, r.rule_id, r.subject, 1)
            elif r.what == "refers":
                if not self.first.exists():
                    self.waiting.appendValue((r.path, r.rule_id, r.message, r.subject))
                    yield row(r.path, r.message, r.rule_id, r.subject, 1)
            elif r.what == "rests":
                self.resting.appendValue((r.path,))
                if self._soft():
                    yield row(r.path, name, _SOFT, None, 1)
            elif r.what == "level":
                known, was = self.level.get(), self._soft()
                if known is None or known[0] < r.ord:
                    self.level.update((r.ord, r.message))
                if self._soft() != was:
                    for (path,) in self.resting.get():
                        yield row(path, name, _SOFT, None, -1 if was else 1)
            elif not self.bearers.containsKey((r.ord,)):
                yield from self._borne(r, row, twice)

    def _soft(self) -> bool:
        known = self.level.get()
        return known is not None and known[1] != "concrete"

    def _borne(self, r: Row, row, twice) -> Iterator[Row]:
        first = self.first.get()
        if first is None:
            for path, rule, message, subject in self.waiting.get():
                yield row(path, message, rule, subject, -1)
            self.waiting.clear()
        elif r.what == "first":
            if first[0] < r.ord:
                yield twice(r.path, r.subject, first[1], 1)
            else:
                for (ord_,), (path, subject) in self.bearers.iterator():
                    if ord_ != first[0]:
                        yield twice(path, subject, first[1], -1)
                    yield twice(path, subject, r.path, 1)
        else:
            before, after = None, None
            for (ord_,), (path, subject) in self.bearers.iterator():
                if ord_ < r.ord and (before is None or before[0] < ord_):
                    before = (ord_, path, subject)
                if ord_ > r.ord and (after is None or after[0] > ord_):
                    after = (ord_, path, subject)
            if before:
                yield twice(r.path, r.subject, before[1], 1)
            if after:
                if before:
                    yield twice(after[1], after[2], before[1], -1)
                yield twice(after[1], after[2], r.path, 1)
        self.bearers.updateValue((r.ord,), (r.path, r.subject))
        if first is None or r.ord < first[0]:
            self.first.update((r.ord, r.path))

    def close(self) -> None:
        pass


def changes(files: DataFrame) -> DataFrame:
    """Problems as they come and go, as CHANGE; for a stream of files (repo_id, path, text), in append mode."""
    provider = files.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if provider != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {PROVIDER}")
    return events(files).groupBy("repo_id", "kind", "id").transformWithState(Ids(), CHANGE, "Append", "None")


def settled(told: DataFrame) -> DataFrame:
    """The problems that stand, with repetitions, of all rows of changes() so far."""
    columns = ["repo_id", "path", "message", "rule_id", "subject"]
    own = told.where(~F.startswith("rule_id", F.lit("N8"))).groupBy(*columns).agg(F.sum("change").cast("int").alias("n")).where("n > 0")
    return own.select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("n")))).select(*columns)


def ratcheted(told: DataFrame) -> DataFrame:
    """repo_id, path, id and provenance of the provisional items that may become concrete, of all rows of changes() so far."""
    soft = told.where(F.col("rule_id") == _SOFT).groupBy("repo_id", "path", "message").agg(F.sum("change").alias("n")).where("n > 0")
    return told.where(F.col("rule_id") == _ITEM).join(soft.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_anti").select("repo_id", "path", F.col("subject").alias("id"), F.lit("concrete").alias("provenance"))
