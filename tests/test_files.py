"""The sink of files: all or nothing, whatever happens to tasks."""

import os
import signal

import pytest
from pyspark.sql import functions as F

from recordloom.sources import files


def there(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


def rows(spark, root, *steps):
    return spark.createDataFrame([(str(root), p, x.encode(), a) for a, p, x in steps], files.SCHEMA)


def test_files_are_created_replaced_and_deleted(spark, tmp_path):
    (tmp_path / "old").write_text("old"), (tmp_path / "gone").write_text("gone"), (tmp_path / "kept").write_text("kept")
    files.write_files(rows(spark, tmp_path, ("create", "a/b/new", "new"), ("create", "kept", "other"), ("replace", "old", "later"), ("replace", "fresh", ""), ("delete", "gone", ""), ("delete", "never", "")).repartition(3))
    assert there(tmp_path) == {"a/b/new": "new", "kept": "kept", "old": "later", "fresh": ""}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "old").write_text("old")
    for path in ("../out", "/etc/x"):
        with pytest.raises(Exception, match="isn't for a file"):
            files.write_files(rows(spark, tmp_path, ("create", "new", "x"), ("replace", "old", "x"), ("create", path, "x")).repartition(2))
    with pytest.raises(Exception, match="told to fail"):
        files.write_files(rows(spark, tmp_path, ("create", "new", "x"), ("replace", "old", "x")).withColumn("content", F.when(F.col("path") == "old", F.raise_error(F.lit("told to fail"))).otherwise(F.col("content"))))
    assert there(tmp_path) == {"old": "old"}


def test_a_killed_task_is_tried_again_or_leaves_nothing(spark, tmp_path, monkeypatch):
    """A worker process is killed between the rows that it stages; with no further try, the files are as they were."""
    mark = tmp_path.parent / "killed"
    target = tmp_path / "repo"
    target.mkdir()

    class Killed(files.Writer):
        def write(self, iterator):
            def own():
                for k, row in enumerate(iterator):
                    if k == 1 and not os.path.exists(mark):
                        open(mark, "w").close()
                        os.kill(os.getpid(), signal.SIGKILL)
                    yield row

            return super().write(own())

    class Source(files.RecordFiles):
        @classmethod
        def name(cls):
            return "killed_files"

        def writer(self, schema, overwrite):
            return Killed(self.options["job"])

    monkeypatch.setattr(files, "RecordFiles", Source)
    own = rows(spark, target, ("create", "one", "1"), ("create", "two", "2"), ("create", "three", "3")).coalesce(1)
    with pytest.raises(Exception, match=r"(?s)worker|crashed|exited"):  # local sessions try a task once
        files.write_files(own)
    assert mark.exists() and there(target) == {}
    files.write_files(own)
    assert there(target) == {"one": "1", "two": "2", "three": "3"}


def test_a_commit_that_fails_is_taken_back(tmp_path, monkeypatch):
    for name in ("old", "gone"):
        (tmp_path / name).write_text(name)
    writer = files.Writer("job")
    row = lambda a, p: type("R", (), {"repo_id": str(tmp_path), "path": p, "content": b"new", "action": a})()
    done = writer.write(iter([row("create", "a"), row("replace", "old"), row("delete", "gone"), row("create", "b/c")]))
    link = os.link
    monkeypatch.setattr(os, "link", lambda a, b: link(a, b) if not b.endswith("c") else (_ for _ in ()).throw(OSError("no room")))
    with pytest.raises(OSError, match="no room"):
        writer.commit([done, None])
    assert there(tmp_path) == {"old": "old", "gone": "gone"}
