"""A sink of files into checkouts: tasks stage what they are given, and one commit puts it in place or leaves all as it was.

    rows.write.format("record_files").mode("append").save()

rows: repo_id (the checkout's folder), path, content (binary) and action. create writes a file where there is none, which is
looked at again when it is put in place, so of two writers one wins and the other leaves the file alone; replace writes it
in any case; delete removes it. Content is written by the tasks into a folder beside the files, `.staged-<job>` at the top of
each checkout, so putting it in place is a link or a rename on the same file system; a task that is lost, or tried twice,
leaves nothing but staged files, which go with that folder. If a step of the commit fails, those before it are taken back.

Checkouts lie in a folder that all executors mount. Paths that lead out of their checkout raise ValueError in the task.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "repo_id string, path string, content binary, action string"


@dataclass
class Staged(WriterCommitMessage):
    """What one task has staged: (action, target, staged file or empty)."""

    steps: list[tuple[str, str, str]] = field(default_factory=list)
    stages: list[str] = field(default_factory=list)


class Writer(DataSourceWriter):
    def __init__(self, job: str):
        self.job = job

    def write(self, iterator: Iterator[Row]) -> Staged:
        context, out = TaskContext.get(), Staged()
        mine = f"{context.partitionId()}-{context.attemptNumber()}-{uuid.uuid4().hex}" if context else uuid.uuid4().hex
        for n, row in enumerate(iterator):
            root = os.path.realpath(row.repo_id)
            target = os.path.normpath(os.path.join(root, row.path))
            if not target.startswith(root + os.sep) or row.action not in ("create", "replace", "delete"):
                raise ValueError(f"{row.action} {row.path} isn't for a file of {row.repo_id}")
            stage = os.path.join(root, f".staged-{self.job}")
            staged = ""
            if row.action != "delete":
                staged = os.path.join(stage, mine, str(n))
                os.makedirs(os.path.dirname(staged), exist_ok=True)
                with open(staged, "wb") as f:
                    f.write(row.content or b"")
                    f.flush()
                    os.fsync(f.fileno())
            if stage not in out.stages:
                out.stages.append(stage)
            out.steps.append((row.action, target, staged))
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        undo: list[tuple[str, str]] = []
        try:
            for message in filter(None, messages):
                for action, target, staged in message.steps:
                    self._put(action, target, staged, undo)
        except BaseException:
            for target, kept in reversed(undo):
                with contextlib.suppress(OSError):
                    os.replace(kept, target) if kept else os.unlink(target)
            raise
        finally:
            self.abort(messages)

    def _put(self, action: str, target: str, staged: str, undo: list[tuple[str, str]]) -> None:
        if action != "delete":
            os.makedirs(os.path.dirname(target), exist_ok=True)
        if action == "create":
            with contextlib.suppress(FileExistsError):
                os.link(staged, target)  # fails where there is a file by now
                undo.append((target, ""))
            return
        kept = ""
        if os.path.lexists(target):
            kept = f"{target}.{self.job}"
            os.replace(target, kept)
            undo.append((target, kept))
        if action == "replace":
            os.link(staged, target)
            if not kept:
                undo.append((target, ""))
        self.kept = [*getattr(self, "kept", []), kept]

    def abort(self, messages: list[Staged | None]) -> None:
        """Removes what is staged; of lost tasks too, for they stage in the same folders."""
        for stage in {s for m in filter(None, messages) for s in m.stages}:
            shutil.rmtree(stage, ignore_errors=True)
        for kept in filter(None, getattr(self, "kept", [])):
            with contextlib.suppress(OSError):
                os.unlink(kept)


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options.get("job") or uuid.uuid4().hex)


def write_files(rows: DataFrame) -> None:
    """Puts rows (repo_id, path, content, action) in place by the sink; a job that fails as a whole leaves no staged file."""
    job = uuid.uuid4().hex
    rows.sparkSession.dataSource.register(RecordFiles)
    try:
        rows.select("repo_id", "path", "content", "action").write.format(RecordFiles.name()).option("job", job).mode("append").save()
    except BaseException:
        # What tasks that are lost have staged, no message tells.
        for root in rows.select("repo_id").distinct().collect():
            shutil.rmtree(os.path.join(os.path.realpath(root[0]), f".staged-{job}"), ignore_errors=True)
        raise
