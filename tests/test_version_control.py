"""Indexes and ignore rules against version control itself."""

import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from recordloom.operators import history
from recordloom.sources import version_control as vc
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="git isn't here")


def git(root, *args):
    return subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-C", str(root), *args], capture_output=True, text=True, check=False).stdout


def checkout(root, files):
    root.mkdir()
    git(root, "init", "-q")
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode())
    return root


def tables(spark, repo, files):
    return spark.createDataFrame([(repo, p, x.encode()) for p, x in files.items()], "repo_id string, path string, content binary")


@pytest.mark.parametrize("version", [2, 4])
def test_tracked_files_and_their_states(spark, tmp_path, version):
    files = {"a.txt": "one\n", "sub/b.txt": "", "sub/deep/é ü.txt": "x" * 5000, "n" * 90 + "/" + "m" * 70: "long", "sub/bb.txt": "two"}
    root = checkout(tmp_path / "repo", files)
    git(root, "add", "-A"), git(root, "update-index", "--index-version", str(version))
    indexes = vc.load_indexes(spark, {"r": f"file://{root}", "none": f"file://{tmp_path}/none"})
    known = vc.tracked(indexes)
    listed = [line.split("\t") for line in git(root, "-c", "core.quotePath=false", "ls-files", "-s").splitlines()]
    assert {(r["path"], r["blob"], oct(r["mode"])[2:], r["stage"]) for r in known.collect()} == {(p, x.split()[1], x.split()[0], int(x.split()[2])) for x, p in listed} and len(listed) == 5
    now = tables(spark, "r", {k: x for k, x in files.items() if k != "sub/bb.txt"} | {"a.txt": "other\n", "new.txt": ""})
    told = vc.states(now, known)
    assert {r["path"]: r["state"] for r in told.collect()} == {k: "clean" for k in files} | {"a.txt": "changed", "new.txt": "untracked", "sub/bb.txt": "lost"}
    folders = spark.createDataFrame([("r", "sub"), ("r", "sub/deep"), ("r", "gone")], "repo_id string, folder string")
    none, heads = spark.createDataFrame([], "repo_id string, path string"), spark.createDataFrame([("r", "h")], "repo_id string, head string")
    assert rows(vc.folder_states(told, folders, heads, none)) == [("r", "gone", False, False, "h"), ("r", "sub", True, False, "h"), ("r", "sub/deep", True, True, "h")]
    broken = indexes.select("repo_id", F.expr("substring(content, 1, 40)").alias("content")).unionByName(indexes.select("repo_id", F.lit(b"DIRC?").alias("content")))
    assert vc.tracked(broken).count() == 0


def test_ignored_paths(spark, tmp_path):
    rng = random.Random(3)
    names = ["a", "b", "build", "x.log", "y.tmp", "keep.log", "doc", "n1", "n2"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) + rng.choice(["", ".log", ".md"]) for _ in range(250)})
    paths = [p for p in paths if not any(q.startswith(p + "/") for q in paths)]
    rules = {".gitignore": "# told\n*.log\n!keep.log\nbuild/\n/doc\na/**/y.tmp\n**/n1/b\nb/**\n!b/x.log\nn?.md\n[!abd]2\n\\#x\nkeep.log.md  \n", "a/.gitignore": "!x.log\nb\n", "doc/.gitignore": "!*\n"}
    root = checkout(tmp_path / "repo", rules)
    told = subprocess.run(["git", "-C", str(root), "check-ignore", "--no-index", "--stdin"], input="\n".join(p for p in paths), capture_output=True, text=True, check=False).stdout.splitlines()
    # Paths that aren't there are taken as files.
    patterns = vc.ignore_patterns(tables(spark, "r", rules))
    own = spark.createDataFrame([("r", p) for p in paths] + [("other", p) for p in paths], "repo_id string, path string")
    assert {r["path"] for r in vc.ignored(own, patterns).collect()} == set(told) and 20 < len(told) < len(paths) - 20
    known = spark.createDataFrame([("r", told[0], 0, 0, "")], vc.TRACKED)
    assert {r["path"] for r in vc.ignored(own, patterns, known).collect()} == set(told[1:])


def test_the_log_of_a_history(spark, tmp_path):
    root = checkout(tmp_path / "repo", {"a": "1"})
    say = lambda n, who: git(root, "-c", f"user.name={who}", "commit", "-q", "--allow-empty", "-m", n)
    for k in range(6):
        say(str(k), "abc"[k % 2])
        if k in (1, 3):
            git(root, "tag", f"v{k}")
    git(root, "checkout", "-q", "-b", "side", "HEAD~2"), say("other", "z"), git(root, "tag", "far"), git(root, "checkout", "-q", "-")
    lines = spark.createDataFrame([("r", x) for x in git(root, "log", "--all", f"--format={vc.LOG_FORMAT}").splitlines()], "repo_id string, line string")
    want = ("r", int(git(root, "rev-list", "--count", "HEAD")), git(root, "rev-parse", "HEAD")[:7], git(root, "describe", "--tags", "--abbrev=0").strip(), len(git(root, "shortlog", "-sne", "HEAD").splitlines()))
    assert rows(history.statistics(*vc.log_tables(lines))) == [want] == [("r", 6, want[2], "v3", 2)]


def test_the_command_line_reads_the_index_and_the_ignore_files(spark, tmp_path, capsys):
    from recordloom import cli
    from tests.repository import base

    root = checkout(tmp_path / "own", base() | {".gitignore": "decisions/\n", "src/lost.py": ""})
    git(root, "add", "-A"), git(root, "commit", "-q", "-m", "one")
    (tmp_path / "log").write_text(git(root, "log", "--all", f"--format={vc.LOG_FORMAT}"))
    at = ["--root", str(root), "--as-of", "2026-07-26"]
    assert cli.main(["adopt", "--log", str(tmp_path / "log"), *at], spark) == 0 and f"1 commits by 1, head {git(root, 'rev-parse', 'HEAD')[:7]}, latest tag None" in capsys.readouterr().out
