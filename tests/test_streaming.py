"""The stream of references against the batch rules, for files in any order and batches of any size."""

import json
import random

import pytest

from recordloom.plans import doctor, integrity
from recordloom.sources.records import Records
from recordloom.sources.snapshot import with_folders
from recordloom.streaming import references
from tests.conftest import rows

COLUMNS = ("repo_id", "path", "message", "rule_id", "subject")


def fleet(seed, n=60):
    """repo_id, path and text of records that share ids, refer to later and to missing ones, and rest on evidence of all levels."""
    rng, out = random.Random(seed), []
    ids = [f"{k:03d}" for k in range(25)] + ["x", "7"]
    runs = [f"e{k}" for k in range(12)]
    for k in range(n):
        repo, state = rng.choice(["a", "b"]), rng.choice(["proposed", "active", "completed"])
        item = {c: "2026-01-01" for c in ("title", "owner_scope", "created", "updated")} | {"id": rng.choice(ids), "status": state, "affected_scopes": [], "depends_on": rng.choices(ids, k=rng.randrange(3)), "provenance": rng.choice(["provisional", "concrete", None])}
        item["acceptance_criteria"] = [{"id": f"c{i}", "text": "t", "state": rng.choice(["satisfied", "pending"]), "evidence": rng.choices(runs, k=rng.randrange(3))} for i in range(rng.randrange(3))]
        if rng.random() < 0.15:
            del item["title"]
        out.append((repo, f"work/{state}/{k:03d}-w/work-item.json", json.dumps(item)))
        run = {c: [] for c in ("commands", "artifacts")} | {"id": rng.choice(runs), "timestamp": "2026-01-01", "work_item": rng.choice([*ids, None]), "result": "passed", "environment": {}, "provenance": rng.choice(["provisional", "concrete", "concrete", None])}
        out.append((rng.choice(["a", "b"]), f"evidence/runs/r{k}.json", json.dumps(run)))
    return out + [("a", "README.md", "no record")]


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", references.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize(("seed", "size"), [(1, 7), (1, 50), (2, 121)])
def test_the_settled_state_is_the_batch_result(spark, store, tmp_path, seed, size):
    files = fleet(seed)
    tree = with_folders(spark.createDataFrame([(a, b, c.encode()) for a, b, c in files], "repo_id string, path string, content binary"))
    r = Records(tree)
    want = [p for rule, ids in ((integrity.work, ("W1",)), (integrity.evidence, ("W1", "J5")), (integrity.dependencies, ("J1",))) for p in rows(rule(r, "2026-07-26"), *COLUMNS) if p[3] in ids]
    random.Random(seed + size).shuffle(files)
    for k in range(0, len(files), size):
        spark.createDataFrame(files[k : k + size], "repo_id string, path string, text string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{k:04d}")
    stream = spark.readStream.schema("repo_id string, path string, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    query = references.changes(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    told = spark.read.parquet(f"file://{tmp_path}/out")
    key = lambda p: tuple(map(str, p))
    assert sorted(rows(references.settled(told), *COLUMNS), key=key) == sorted(want, key=key) and {p[3] for p in want} == {"W1", "J1", "J5"}
    if size < 121:
        assert told.where("change < 0").count() > 10
    assert rows(references.ratcheted(told), "repo_id", "path", "id") == rows(doctor.ratchet(r), "repo_id", "path", "id") != []
    r.release()


def test_another_state_store_is_refused(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'r' AS repo_id", "'p' AS path", "'{}' AS text")
    with pytest.raises(ValueError, match="RocksDB"):
        references.changes(stream)
