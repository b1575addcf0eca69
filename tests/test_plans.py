import hashlib
import json

import pytest
from pyspark.sql import functions as F

from recordloom.plans import adoption, change, doctor, fleet, integrity, planning, report, research
from recordloom.sources import snapshot
from recordloom.sources.records import Records
from tests.conftest import rows
from tests.repository import AS_OF, base, evidence, item


def records(spark, **repos):
    return Records(snapshot.from_texts(spark, repos))


@pytest.fixture(scope="module")
def plans(spark):
    tree = {
        "todos/12-search/README.md": "# 12 — Search\n\nSee [login](../completed/03-login/README.md#top), [doc](../../docs/a.md), [dir](sub/), [web](https://x.test/y), [self](#a).\n",
        "todos/completed/03-login/README.md": "# Login\n", "todos/deferred/20-i18n/notes.md": "# I18n\n", "todos/README.md": "index", "todos/loose-note.md": "no heading",
        "ROADMAP.md": "# Map\n## Now\n- [ ] Ship **it**\n- [x] Drawn up\n## Later\n- Dream\n## Misc\n- ignored\n",
        "tracking/decisions.md": "## DEC-001: Use tables\nStatus: Accepted\nDate: 2026-02-03\nbecause\n## DEC-002: Other\nStatus: odd\n",
        "tracking/risks.md": "| id | what |\n| RISK-001 | Slow disks | P1 | mitigated | team | buy more |\n| RISK-002 | Rain |\n",
        "tracking/milestones.md": "## M0: Start\nStatus: shipped\n## M1: Grow\nStatus: open\n",
        "docs/a.md": "[s](../todos/12-search/README.md) and todos/unknown/x here\n", "NOTES.md": "---\nsource_of_truth: todos/completed/03-login\n---\n",
    }
    return records(spark, r=base() | tree | item("200", "active", _slug="busy", source="todos/12-search"))


def test_discovery_and_allocation(plans):
    got = {r["slug"]: (r["lifecycle"], r["title"], r["item_id"], r["home"]) for r in planning.planned(plans).collect()}
    assert got["search"] == ("active", "Search", "012", "work/active/012-search")
    assert got["login"] == ("completed", "Login", "003", "work/completed/003-login")
    assert got["i18n"] == ("deferred", "I18n", "020", "work/deferred/020-i18n")
    assert got["loose-note"][:3] == ("active", "Loose Note", "201")
    assert {k: v[0] for k, v in got.items() if k in ("ship-it", "drawn-up", "dream")} == {"ship-it": "active", "drawn-up": "completed", "dream": "deferred"}
    assert "ignored" not in got and got["ship-it"][1] == "Ship it"
    assert len({v[2] for v in got.values()}) == len(got)


def test_links_are_rebased(plans):
    own = planning.rebased(planning.planned(plans)).where("slug = 'search'").first()["narrative"]
    assert own.endswith("See [login](../../completed/003-login/README.md#top), [doc](../../../docs/a.md), [dir](README.md), [web](https://x.test/y), [self](#a).\n")


def test_tracking(plans):
    assert rows(planning.tracked_decisions(plans, AS_OF), "decision_id", "title", "status", "date") == [("0002", "Use tables", "accepted", "2026-02-03"), ("0003", "Other", "accepted", AS_OF)]
    assert rows(planning.tracked_risks(plans, AS_OF), "finding_id", "observed", "risk", "state", "reconciliation") == [("001", "[RISK-001] Slow disks", "high", "reconciled", "buy more"), ("002", "[RISK-002] Rain", "medium", "open", "See source risk register.")]
    assert rows(planning.tracked_milestones(plans), "item_id", "slug", "status", "criterion_state") == [("300", "milestone-grow", "active", "pending"), ("301", "milestone-start", "completed", "waived")] or rows(planning.tracked_milestones(plans), "item_id", "slug", "status", "criterion_state") == [("300", "milestone-start", "completed", "waived"), ("301", "milestone-grow", "active", "pending")]


def test_issues(spark):
    issues = spark.createDataFrame([("r", 1, " Fix it ", None, "OPEN", "u1"), ("r", 2, "", "b", "closed", None)], "repo_id string, number int, title string, body string, state string, url string")
    assert rows(planning.from_issues(issues), "lifecycle", "slug", "title", "source") == [("active", "fix-it", "Fix it", "github:#1"), ("completed", "issue-2", "issue-2", "github:#2")]
    assert planning.from_issues(issues, 1).first()["source"] == "github:#2"


def test_retirement(spark, plans):
    state = {r["source"]: r["migrated"] for r in planning.migrated(plans).collect()}
    assert state["todos/12-search"] and not state["todos/completed/03-login"]
    git = spark.createDataFrame([("r", "todos", True, True, "abc")], "repo_id string, folder string, tracked boolean, clean boolean, head string")
    assert rows(planning.retirement(plans, git)) == [("r", "todos", "block", "3 unmigrated items")]
    done = records(spark, r={"todos/1-a/README.md": "# A\n"} | item("001", "active", source="todos/1-a"))
    assert rows(planning.retirement(done, git), "action") == [("delete",)]
    assert rows(planning.retirement(done, git.withColumn("clean", F.lit(False))), "action", "reason") == [("archive", "uncommitted or ignored files")]


def test_inbound_references(spark):
    r = records(spark, r=item("003", "completed", _slug="login") | {"docs/a.md": "[l](../todos/completed/003-login/notes.md) todos/gone/x\n", "N.md": "source_of_truth: todos/003-login/\n", "archive/z.md": "todos/q"})
    refs = planning.references(r, spark.createDataFrame([("r", "todos")], "repo_id string, folder string"))
    assert rows(planning.rewritten(refs), "path", "line") == [("N.md", "source_of_truth: work/completed/003-login/"), ("docs/a.md", "[l](../work/completed/003-login/README.md) todos/gone/x")]
    assert rows(planning.unresolved(refs), "report") == [("docs/a.md:1: todos/gone/x",)]


def test_change_hits(spark):
    r = records(spark, r=base())
    changed = spark.createDataFrame([("r", "governance/owners.json"), ("r", "src/x.py")], "repo_id string, path string")
    patch = spark.createDataFrame([("r", "p", "--- KEEP_ME\n+++ b\n context KEEP_ME\n+call(KEEP_ME)\n-KEEP_MEAT\n")], "repo_id string, path string, text string")
    assert rows(change.path_hits(r, changed)) == [("r", "governance/owners.json", "rules")]
    assert rows(change.symbol_hits(r, patch)) == [("r", "KEEP_ME", "rules")]
    assert change.symbol_hits(r, patch.withColumn("text", F.lit(" KEEP_ME\n+other\n"))).isEmpty()
    assert change.violations(r, change.changed_paths([changed, changed]), patch).count() == 2


def test_doctor(spark):
    broken = base() | {"lib/AGENTS.md": "x", "lib/_audit/README.md": "x", "NOTE.md": "---\nsource_of_truth: gone/file.md; some prose; README.md\n---\n", "audits/registry.json": json.dumps({"scopes": [{"path": "nowhere", "contract": "AGENTS.md"}]}), "governance/owners.json": json.dumps({"scopes": []})}
    broken |= item("002", "active", provenance="provisional")
    del broken["AGENTS.md"]
    r = records(spark, bad=broken, good=base())
    shipped = spark.createDataFrame([("a.json", b"{}")], "name string, content binary")
    ignored = spark.createDataFrame([("good", "evidence/runs/20260101-seed.json"), ("good", "src/x")], "repo_id string, path string")
    found = doctor.diagnose(r, shipped, ignored).persist()
    assert rows(found.where("repo_id = 'bad'"), "code", "subject") == [("audit-incomplete", "lib/_audit/alignment-report.md"), ("audit-incomplete", "lib/_audit/inventory.md"), ("contract-unregistered", "lib/AGENTS.md"), ("no-root-contract", None), ("registry-stale", "nowhere"), ("schema-missing", "a.json"), ("source-of-truth-stale", "NOTE.md")]
    assert rows(found.where("repo_id = 'good'"), "code") == [("gitignored-record",), ("schema-missing",)]
    assert rows(doctor.ratchet(r), "repo_id", "id") == [("bad", "002")]
    assert rows(doctor.preflight_epoch(r, AS_OF), "repo_id", "value") == [("bad", '{"enabled":true,"required_from_date":"2026-07-26"}')]
    assert ("bad", "register contract", "lib/AGENTS.md") in rows(doctor.repairs(r, AS_OF, found))


def test_fleet(spark):
    up, over = b"one\ntwo\n", b"@@ -2 +2 @@\n-two\n+TWO\n"
    mine = b"one\nTWO\n"
    sha = lambda x: hashlib.sha256(x).hexdigest()
    files = [{"mode": "exact", "upstream_path": "a", "adopter_path": "a", "upstream_sha256": sha(up), "adopter_sha256": sha(up)}, {"mode": "overlay", "upstream_path": "a", "adopter_path": "b", "upstream_sha256": sha(up), "adopter_sha256": sha(mine), "overlay_path": "overlays/b.patch", "overlay_sha256": sha(over)}]
    adopters = [
        {"id": "pin", "repository": "o/pin", "default_branch": "main", "validation_commands": [], "consumption": {"type": "pypi", "package": "tool", "version_file": "req.txt"}},
        {"id": "ven", "repository": "O/ven", "default_branch": "main", "validation_commands": [], "consumption": {"type": "vendored", "version_file": "V", "upstream_version": "0.1.0", "upstream_revision": "u1", "files": files}},
        {"id": "old", "repository": "o/old", "default_branch": "main", "validation_commands": [], "consumption": {"type": "pypi", "package": "tool", "version_file": "req.txt"}},
        {"id": "gone", "repository": "o/gone", "default_branch": "main", "validation_commands": [], "consumption": {"type": "pypi", "package": "tool", "version_file": "req.txt"}},
    ]
    r = records(spark, hub=base() | {"governance/adopters.json": json.dumps({"version": 1, "upstream": {"repository": "o/hub", "package": "tool"}, "adopters": adopters}), "overlays/b.patch": over})
    heads = spark.createDataFrame([("o/pin", "main", "h1"), ("O/ven", "main", "h2"), ("o/old", "main", "h3")], "repository string, branch string, head string")
    held = [("o/pin", "h1", "req.txt", b"tool==0.1.0\n"), ("o/old", "h3", "req.txt", b"tool==0.0.9\n"), ("O/ven", "h2", "V", b"0.1.0\n"), ("o/hub", "u1", "a", up), ("O/ven", "h2", "a", up), ("O/ven", "h2", "b", mine)]
    remote = spark.createDataFrame(held, "repository string, revision string, path string, content binary")
    clones = spark.createDataFrame([("git@h.test:o/pin.git", "/x", True), ("https://h.test/o/pin", "/y", False), ("https://h.test/o/stray", "/z", True)], "url string, path string, marked boolean")
    out = {x["id"]: x for x in fleet.verify(r, heads, remote, clones).collect()}
    assert out["pin"]["ok"] and out["pin"]["local_checkouts"] == ["/x", "/y"]
    assert out["ven"]["ok"] and {"exact checksum parity: a", "reviewable overlay parity: b"} <= set(out["ven"]["checks"])
    assert out["old"]["errors"] == ["declared version 0.0.9 is stale; current release is 0.1.0"]
    assert out["gone"]["errors"] == ["branch can't be resolved: main"]
    assert rows(fleet.unregistered(r, clones), "key") == [("o/stray",)]
    verified = fleet.verify(r, heads, remote, clones)
    assert rows(fleet.fleet_ok(verified)) == [("hub", 4, False)]
    package = spark.createDataFrame([("hub", "passed", "0.1.0", "https://p/x/", ["https://p/x"])], "repo_id string, result string, release string, url string, artifacts array<string>")
    assert rows(fleet.closeout(r, verified, package), "errors") == [(["fleet verification failed"],)]
    bad = remote.where("path <> 'b'").unionByName(spark.createDataFrame([("O/ven", "h2", "b", b"changed")], remote.schema))
    assert any("does not reconstruct" in e for e in fleet.verify(r, heads, bad, clones).where("id = 'ven'").first()["errors"])


def test_archives(spark):
    members = spark.createDataFrame([("w", "pkg/a.py"), ("w", "pkg/schemas/x.json"), ("w", "pkg-1.dist-info/RECORD"), ("bad", "pkg/a.py"), ("bad", "loose.py")], "archive string, member string")
    assert rows(fleet.archive_problems(members, {"pkg/schemas/": 1}, ("loose.py",)), "repo_id", "message") == [("bad", "archive has 2 top-level packages"), ("bad", "expected 1 members below pkg/schemas/, found 0"), ("bad", "flat modules: loose.py")]


def test_adoption(spark):
    r = records(spark, r={"CODEOWNERS": "# c\n*.py @a @b\ndocs/ @a # x\nnoone\n*.py @a\n", ".github/workflows/ci.yml": "on: push\nname: 'Build'\n", ".github/workflows/x.yaml": "on: push\n", "pyproject.toml": 'version = "2.3.4"\n'} | item("007", "active"))
    assert rows(adoption.code_owners(r), "handle", "globs") == [("@a", ["*.py", "docs/"]), ("@b", ["*.py"])]
    assert rows(adoption.workflows(r), "title") == [("Build",), ("x",)]
    assert rows(adoption.detected_version(r), "version") == [("2.3.4",)]
    assert rows(adoption.next_ids(r, "work")) == [("r", "008")] and rows(adoption.next_ids(r, "decisions")) == [("r", "0001")]
    made = adoption.new_work_items(spark.createDataFrame([("r", "New thing")], "repo_id string, title string"), r, AS_OF)
    assert made.first()["path"] == "work/active/008-new-thing/work-item.json" and json.loads(made.first()["text"])["id"] == "008"
    plan = adoption.missing_files(made.unionByName(spark.createDataFrame([("r", "CODEOWNERS", "x")], made.schema)), r)
    assert rows(plan, "path", "action") == [("CODEOWNERS", "skip"), ("work/active/008-new-thing/README.md", "create"), ("work/active/008-new-thing/work-item.json", "create")]
    assert rows(adoption.report_counts(plan)) == [("r", 1, 0, 0, 1)]


def test_research(spark):
    meta = {
        "version": 1, "claim_freshness": {"policy": "research/policy.md", "last_reviewed": "2026-07-01", "next_review": "2026-08-20", "documents": ["research/paper.md", "research/lost.md"]},
        "lifecycle": {"states": ["proposed", "active", "blocked", "deferred", "completed"], "set_documents": [{"path": "research/paper.md", "pattern": "states \\{([^}]+)\\}"}], "figure_documents": [{"path": "research/paper.md", "section": "Figure"}]},
        "benchmark": {"task_count": 24, "documents": [{"path": "research/paper.md", "pattern": "(\\d+) tasks"}], "study_hypotheses": {"S1": "H1", "S2": "H2"}, "range_documents": [{"path": "research/paper.md", "pattern": "H(\\d+)–H(\\d+)"}], "mapping_documents": ["research/paper.md"]},
        "threats": {"ids": ["T1", "T2"], "pattern": "\\*\\*(T\\d)\\*\\*", "documents": ["research/paper.md"]}, "proposed_state_trace": [{"path": "src/a.py", "tokens": ["x", "zz"]}],
    }
    paper = "states {proposed, active, blocked, completed, deferred}\n25 tasks H1–H2\n| S1 | H1 |\n| S2 | H3 |\n**T1** **T1** **T9**\n## Figure\n```\nproposed active blocked deferred\n```\n## End\n"
    r = records(spark, r={"research/metadata.json": json.dumps(meta), "research/paper.md": paper, "research/policy.md": "p", "src/a.py": "x"}, none={"research/paper.md": "p", "research/protocol.md": "p"}, free={"README.md": "x"})
    told = {x["repo_id"]: [] for x in r.repos.collect()}
    for x in research.facts(r, AS_OF).collect():
        told[x["repo_id"]].append(x["message"])
    assert told["free"] == [] and told["none"] == ["missing research metadata"]
    for said in ("cadence exceeds 30 days", "does not exist: research/lost.md", "not declared: research/policy.md", "lifecycle states contradict", "missing state(s): completed", "expected 24; observed 25", "mapping contradicts", "repeated: T1", "missing: T2", "unexpected threat: T9", "src/a.py lacks: zz"):
        assert sum(said in m for m in told["r"]) == 1, said
    assert len(told["r"]) == 11


def test_reports(spark):
    r = records(spark, r=base())
    text = report.dashboard(r, "2026-10-01").first()["dashboard"]
    assert "| Invariants | 1 |" in text and "| completed | 1 |" in text and "| . | 2026-09-15 |" in text and text.endswith("No active or blocked work.\n")
    assert report.invariant_table(r).first()["block"].splitlines()[-1] == "| INV-1 | All is recorded. | human review (escalation) |"
    schemas = spark.createDataFrame([(0, "Run", "evidence/runs", "e.json", '{"required": ["id", "at"]}')], "pos int, record string, location string, file string, text string")
    assert report.catalog(schemas).first()["block"].splitlines()[-1] == "| Run | `evidence/runs` | `e.json` | `id`, `at` |"
    df = spark.createDataFrame([("a <!-- generated:x -->\nold $1\n<!-- /generated:x --> b", "n\\ew")], "t string, c string")
    assert df.select(report.replace_block(F.col("t"), "x", F.col("c"))).first()[0] == "a <!-- generated:x -->\nn\\ew\n<!-- /generated:x --> b"
    assert spark.range(1).select(report.as_json({"b": F.lit(1), "a": F.lit(None).cast("string")})).first()[0] == '{"a":null,"b":1}'


def test_overlay_and_folders(spark):
    own = spark.createDataFrame([("VERSION", b"1"), ("a/x", b"2")], "path string, content binary")
    over = spark.createDataFrame([("c1", "a/x", b"3"), ("c1", "meta.json", b"{}"), ("c2", None, None)], "repo_id string, path string, content binary")
    tree = snapshot.with_folders(snapshot.overlay(own, over))
    assert rows(tree.where("not is_dir"), "repo_id", "path", "text") == [("c1", "VERSION", "1"), ("c1", "a/x", "3"), ("c2", "VERSION", "1"), ("c2", "a/x", "2")]
    assert rows(tree.where("is_dir and repo_id = 'c1'"), "path") == [(".",), ("a",)]


def test_overlay_of_parts_and_equal_contents(spark, monkeypatch):
    monkeypatch.setattr(snapshot, "CASES", 7)
    own = spark.createDataFrame([("a", b"1"), ("b", b"1"), ("e/", None)], "path string, content binary")
    over = spark.createDataFrame([(f"c{k}", "b" if k % 2 else None, b"same" if k % 2 else None) for k in range(60)], "repo_id string, path string, content binary")
    files, contents = snapshot.overlay_refs(own, over)
    assert contents.count() == 2 and files.select("part").distinct().count() > 5
    out = snapshot.with_contents(files, contents)
    want = sorted((f"c{k}", p, c) for k in range(60) for p, c in (("a", "1"), ("b", "same" if k % 2 else "1"), ("e/", None)))
    assert rows(out.select("repo_id", "path", F.decode("content", "UTF-8").alias("text")), "repo_id", "path", "text") == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert snapshot.overlay(own, over.limit(0)).count() == 0


def test_load_from_folders(spark, tmp_path):
    (tmp_path / "work").mkdir()
    (tmp_path / "VERSION").write_text("1.0.0\n")
    (tmp_path / "work" / "n.md").write_text("x")
    tree = snapshot.load(spark, {"r": str(tmp_path)})
    assert rows(tree, "path", "is_dir") == [(".", True), ("VERSION", False), ("work", True), ("work/n.md", False)]


def test_streaming(spark, tmp_path):
    from recordloom.streaming import records as streaming

    (tmp_path / "in").mkdir()
    for path, text in (evidence() | evidence("20260102-x", id="other") | {"evidence/runs/bad.json": "["}).items():
        (tmp_path / "in" / path.rsplit("/", 1)[1]).write_text(text)
    stream = streaming.evidence_problems(streaming.evidence_stream(spark, str(tmp_path / "in"), "r"))
    query = stream.writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("told"), "path", "message") == [("20260102-x.json", "evidence id must match filename"), ("bad.json", "expected a JSON object")]


def test_cli(spark, tmp_path, capsys):
    from recordloom import cli

    for path, text in base().items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    at = ["--root", str(tmp_path), "--as-of", AS_OF]
    assert cli.main(["dashboard", "--write", *at], spark) == 0
    (tmp_path / "VERSION").write_text("odd\n")
    assert cli.main(["validate", *at], spark) == 1 and "must be semantic" in capsys.readouterr().out
    (tmp_path / "changed").write_text("governance/owners.json\n")
    assert cli.main(["changed", "--changed", str(tmp_path / "changed"), *at], spark) == 1
    assert cli.main(["next-id", *at], spark) == 0 and "work 002" in capsys.readouterr().out


def test_cli_makes_repositories_that_hold(spark, tmp_path, capsys):
    from recordloom import cli

    at = ["--root", str(tmp_path / "own"), "--as-of", AS_OF]
    assert cli.main(["init", "--write", *at], spark) == 0 and "create VERSION" in capsys.readouterr().out
    assert cli.main(["new", "--title", "First thing", "--write", *at], spark) == 0 and "work/active/001-first-thing/work-item.json" in capsys.readouterr().out
    assert cli.main(["dashboard", "--write", *at], spark) == 0
    assert cli.main(["validate", *at], spark) == 0, capsys.readouterr().out
    assert cli.main(["adopt", *at], spark) == 0 and "skip VERSION" in capsys.readouterr().out
    assert cli.main(["fleet-verify", *at], spark) == 1 and cli.main(["release-closeout", *at], spark) == 1
    assert cli.main(["spec"], spark) == 0 and "`work-item.schema.json`" in capsys.readouterr().out


def test_shipped_schemas_take_the_sound_repository(spark):
    from recordloom import schemas

    r = Records(snapshot.from_texts(spark, {"a": base(), "b": base() | evidence(result="unknown")}))
    assert rows(integrity.schemas(r, schemas.SHIPPED), "repo_id", "message") == [("b", "schema result: 'unknown' is not one of ['passed', 'failed', 'partial', 'blocked']")]


def test_records_of_files_keep_the_files_alone(spark):
    from recordloom.plans import record_queries

    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    files = record_queries.fleet(table)
    assert files._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 1  # lines are gathered once
    kept = Records.of_files(snapshot.from_texts(spark, {"a": base(), "b": base() | {"work/active/009-x/work-item.json": "[1]"}}).where("not is_dir").select("repo_id", "path", "content"))
    plain = records(spark, a=base(), b=base() | {"work/active/009-x/work-item.json": "[1]"})
    assert "text" not in kept.work.columns
    assert rows(kept.tree, "repo_id", "path", "text", "is_dir") == rows(plain.tree, "repo_id", "path", "text", "is_dir")
    assert rows(kept.repos) == rows(plain.repos) and rows(kept.items, "repo_id", "id", "missing") == rows(plain.items, "repo_id", "id", "missing")
    kept.release()


def test_entries_of_one_glob_are_told_each_once(spark):
    surface = {"version": 1, "protected": [{"glob": g, "reason": why} for g, why in (("src/*", "one"), ("src/*", "two"), ("src", "three"), ("lib/*.py", "four"))]}
    r = records(spark, r=base() | {"governance/frozen-surface.json": json.dumps(surface)})
    changed = spark.createDataFrame([("r", "src/a.py"), ("r", "lib/x.md"), ("r", "src/a.py")], "repo_id string, path string")
    found = change.path_hits(r, changed)
    assert rows(found) == [("r", "src/a.py", "one"), ("r", "src/a.py", "three"), ("r", "src/a.py", "two")]
    # Pairs of paths and entries come from the last join; only paths and globs are made distinct before it.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate")


def test_provenance_keeps_the_criteria_in_their_items(spark):
    criterion = lambda i, evidence, state="satisfied", **more: {"id": i, "text": "x", "state": state, "evidence": evidence} | more
    files = evidence("soft", provenance="provisional") | evidence("gone", provenance="concrete")
    files |= item("002", acceptance_criteria=[criterion("A", ["gone", "soft", "soft"]), criterion("B", ["other"]), criterion("C", None, provenance="inferred"), criterion("D", ["soft"], "waived"), criterion(None, ["soft"])])
    files |= item("003", "active", acceptance_criteria=[criterion("A", ["soft"]), criterion("B", ["soft"])]) | item("004", "active", provenance="provisional", acceptance_criteria=[criterion("A", ["soft"])])
    files |= item("005", provenance="inferred", acceptance_criteria=[]) | item("006", "active", acceptance_criteria=[criterion("A", ["soft"], "pending"), None])
    r = records(spark, r=base() | files)
    r.criteria = None  # no row for each criterion
    rests, concrete = "completed item criterion {} rests on non-concrete evidence; ratchet it to concrete before completing (P2)", "concrete item rests on non-concrete evidence; mark it provisional/inferred or ratchet the evidence (P3)"
    found = integrity.provenance(r, AS_OF)
    want = [("002", rests.format("A")), ("002", rests.format("C")), ("002", rests.format("")), ("003", concrete), ("005", "item provenance 'inferred' cannot be completed; ratchet to concrete first (P2)")]
    assert sorted(map(tuple, found.select("subject", "message").collect())) == sorted(want)
    assert {tuple(x) for x in found.select("repo_id", "rule_id").collect()} == {("r", "J15")}


def test_many_protected_entries_are_not_sent_through_the_driver(spark, monkeypatch):
    from recordloom.operators import relational as ops

    monkeypatch.setattr(ops, "FEW_ROWS", 2)
    surface = {"version": 1, "protected": [{"glob": g, "reason": why} for g, why in (("src/*", "one"), ("src/*", "two"), ("src", "three"), ("lib/*.py", "four"))]}
    r = records(spark, r=base() | {"governance/frozen-surface.json": json.dumps(surface)})
    found = change.path_hits(r, spark.createDataFrame([("r", "src/a.py"), ("r", "lib/x.md"), ("r", "src/a.py")], "repo_id string, path string"))
    assert rows(found) == [("r", "src/a.py", "one"), ("r", "src/a.py", "three"), ("r", "src/a.py", "two")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_files_that_are_asked_for_are_rendered(spark):
    from recordloom.plans import record_queries

    r = Records.of_files(record_queries.fleet(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")))
    assert "l_orderkey" in _plan(r.manifests)
    for df in (r.repos, adoption.next_ids(r, "work"), integrity.orphans(r, AS_OF)):
        assert "l_orderkey" not in _plan(df)
    assert "o_orderkey" not in _plan(r.below("evidence")) and "o_orderkey" not in _plan(r.one("governance/owners.json"))
    assert "s_suppkey" not in _plan(r.manifests)
    r.release()


def test_orphans_are_told_in_one_pass(spark):
    tree = {f"work/{p}": "x" for p in ("active/a/README.md", "active/b/_audit/x.md", "b/AGENTS.md", "_c/README.md", "active/.d/README.md", "active/e/sub/README.md", "README.md", "active/README.md", "f/notes.md", "g/README.md", "g/work-item.json", "active/h/README.md", "active/h/work-item.json")}
    own = integrity.orphans(records(spark, r=tree), AS_OF)
    assert rows(own, "path") == [("work/active/a",), ("work/active/b",), ("work/b",)]
    assert "Join" not in _plan(own)


def test_criteria_are_judged_within_their_manifest(spark):
    given = [{"id": i, "text": "x", "state": s, "evidence": []} for i, s in (("AC-1", "satisfied"), ("AC-2", "pending"), ("AC-1", "pending"), (None, "pending"))]
    r = records(spark, r=base() | item("300", "active", _slug="busy", acceptance_criteria=given) | {"work/active/300-busy/README.md": "- [x] **AC-1** a\n- [x] **AC-2** b\n- [ ] **AC-1** c\n"})
    at = "path like '%300-busy%'"
    assert rows(integrity.criteria(r, AS_OF).where(at).where("rule_id = 'W5'"), "path", "subject") == [("work/active/300-busy/work-item.json", "300")] * 2
    assert rows(integrity.checkboxes(r, AS_OF).where(at), "path", "message") == [("work/active/300-busy/README.md", f"criterion {x}") for x in (" has no checkbox in README", "AC-1 is satisfied but its README checkbox is unchecked", "AC-2 is pending but its README checkbox is checked")]
    assert "Window" not in _plan(integrity.criteria(r, AS_OF))


def test_small_tables_that_make_many_files_are_dealt_to_all_cores(spark):
    from recordloom.plans import fleet_queries, repository_queries

    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    assert repository_queries.fleet(table).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert fleet_queries.papers(table).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_front_matter_parts_a_text_once(spark):
    from recordloom.functions import text as t

    given = [("---\na: 1\nb: x: y\n a : 2\n\n---\nrest: 3",), ("---\na: 1",), ("---\nodd\n---\n",), ("x",), ("",), (None,), ("---\n---",), (" --- \nk:\n---\n",)]
    df = spark.createDataFrame(given, "text string").select(t.front_matter("text").alias("m"))
    assert [r["m"] for r in df.collect()] == [{"a": "2", "b": "x: y"}, None, None, None, None, None, {}, {"k": ""}]
    many = spark.range(1).selectExpr("concat('---\\na: ', id, '\\n---') AS text").select(t.front_matter("text").alias("m"))
    assert _plan(many).count("split(") == 1
