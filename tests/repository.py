"""A small sound repository, and cases that change it."""

import json

AS_OF = "2026-07-26"
FLAGS = {"concurrency": {"enforce_disjoint_active_scopes": True}}


def item(number="001", status="completed", **more):
    own = {
        "id": number, "title": f"Item {number}", "status": status, "owner_scope": "governance", "affected_scopes": [], "depends_on": [],
        "preflight": {"created_before_work_started": True, "created_at": "2026-01-01", "note": "before"},
        "acceptance_criteria": [{"id": "AC-1", "text": "done", "state": "satisfied" if status == "completed" else "pending", "evidence": ["20260101-seed"] if status == "completed" else []}],
        "created": "2026-01-01", "updated": "2026-01-02",
    } | more
    at = f"work/{own.pop('_dir', status)}/{number}-{own.pop('_slug', 'seed')}"
    return {f"{at}/work-item.json": json.dumps(own), f"{at}/README.md": f"# {number}\n"}


def evidence(name="20260101-seed", **more):
    own = {"id": name, "timestamp": "2026-01-02T10:00:00+00:00", "work_item": "001", "result": "passed", "commands": [{"command": "make", "exit_code": 0}], "artifacts": [], "environment": {"os": "any"}} | more
    return {f"evidence/runs/{name}.json": json.dumps(own)}


def owners(**more):
    return {"governance/owners.json": json.dumps({"scopes": [{"id": "governance", "paths": ["**"], "owner": "team"}], "roles": [{"id": "keeper", "description": "keeps", "scopes": ["governance"]}], "preflight": {"enabled": True, "required_from_id": 2}} | more)}


def base():
    return {
        "VERSION": "0.1.0\n", "AGENTS.md": "# Contract\n", "README.md": "# Sample\n\nThe current release **0.1.0**.\n",
        "governance/invariants.json": json.dumps({"version": 1, "invariants": [{"id": "INV-1", "statement": "All is recorded.", "rationale": "so", "escalation": "ask", "enforced_by": None}]}),
        "governance/frozen-surface.json": json.dumps({"version": 1, "protected": [{"glob": "governance/**", "reason": "rules", "symbols": ["KEEP_ME"]}]}),
        "audits/registry.json": json.dumps({"scopes": [{"path": ".", "owner": "team", "contract": "AGENTS.md", "last_reviewed": "2026-06-15", "next_review": "2026-09-15", "alignment": "aligned", "notes": ""}]}),
        "decisions/0001-first.md": "---\nid: 0001\ntitle: \"First\"\nstatus: accepted\ndate: 2026-01-01\nsupersedes: []\n---\n\n# First\n",
        "governance/policies/001-basic.md": "---\nid: 001\ntitle: Basic\nstatus: active\napplies_to: [all]\n---\n",
    } | owners() | item() | evidence()


#: Names of the conformance cases and the fragments of messages that they pin.
#: name: (changes, expectation, fragment); a change to None removes the file. `_dashboard` tells what becomes of it.
CASES = {
    "valid-minimal": ({}, "accept", ""),
    "valid-proposed-work": (item("002", "proposed"), "accept", ""),
    "valid-provisional-work": (item("002", "active", provenance="provisional"), "accept", ""),
    "valid-release-label": ({"RELEASE_LABEL": "0.1.0-rc.1\n"}, "accept", ""),
    "active-depends-on-proposed": (item("002", "proposed") | item("003", "active", depends_on=["002"]), "reject", "depends on proposed work item"),
    "completed-with-pending": (item(acceptance_criteria=[{"id": "AC-1", "text": "x", "state": "pending", "evidence": []}]), "reject", "completed item has pending criterion"),
    "satisfied-without-evidence": (item(acceptance_criteria=[{"id": "AC-1", "text": "x", "state": "satisfied", "evidence": []}]), "reject", "satisfied without evidence"),
    "unknown-dependency": (item(depends_on=["999"]), "reject", "unknown dependency"),
    "unregistered-contract": ({"lib/AGENTS.md": "# Lib\n"}, "reject", "not registered in audits/registry.json"),
    "dependency-cycle": (item("010", "active", depends_on=["011"]) | item("011", "active", depends_on=["010"]), "reject", "dependency cycle: 010 -> 011 -> 010"),
    "completed-provisional-work": (item("002", provenance="provisional"), "reject", "cannot be completed; ratchet to concrete first (P2)"),
    "status-directory-mismatch": (item(status="active", _dir="completed", acceptance_criteria=[{"id": "AC-1", "text": "x", "state": "satisfied", "evidence": ["20260101-seed"]}]), "reject", "status 'active' does not match directory 'completed'"),
    "invalid-semantic-version": ({"VERSION": "not-semver\n", "README.md": "# Sample\n"}, "reject", "must be semantic (MAJOR.MINOR.PATCH)"),
    "release-label-version-mismatch": ({"RELEASE_LABEL": "9.9.9-rc.1\n"}, "reject", "must equal VERSION"),
    "schema-invalid-evidence": (evidence(result="unknown"), "reject", "schema result: 'unknown' is not one of"),
    "orphan-work-directory": ({"work/active/099-orphan/README.md": "# Orphan\n"}, "reject", "work directory holds planning content"),
    "disjoint-active-scopes": (owners(**FLAGS) | item("002", "active") | item("003", "active"), "reject", "active scope conflict with 003 on governance"),
    "missing-dashboard": ({"_dashboard": "remove"}, "reject", "missing generated dashboard"),
    "stale-dashboard": ({"_dashboard": "edited\n"}, "reject", "dashboard is stale"),
    "readme-release-drift": ({"README.md": "current release **9.9.9**\n"}, "reject", "but VERSION is '0.1.0'"),
}
DASHBOARD = "audits/reports/dashboard.md"
EVIDENCE_SCHEMA = {
    "type": "object", "required": ["id", "timestamp", "work_item", "result", "commands", "artifacts", "environment"],
    "properties": {
        "id": {"type": "string", "minLength": 1}, "timestamp": {"type": "string", "format": "date-time"}, "work_item": {"type": "string", "pattern": "^[0-9]{3,}$"},
        "result": {"enum": ["passed", "failed", "partial", "blocked"]}, "artifacts": {"type": "array", "items": {"type": "string"}}, "environment": {"type": "object"},
        "commands": {"type": "array", "items": {"type": "object", "required": ["command", "exit_code"], "properties": {"command": {"type": "string"}, "exit_code": {"type": "integer"}}}},
    },
}
WORK_SCHEMA = {
    "type": "object", "required": ["id", "title"],
    "properties": {
        "id": {"type": "string", "pattern": "^[0-9]{3,}$"}, "status": {"enum": ["proposed", "active", "blocked", "deferred", "completed"]}, "depends_on": {"type": "array", "uniqueItems": True, "items": {"type": "string"}},
        "preflight": {"type": "object", "properties": {"created_before_work_started": {"const": True}}},
        "acceptance_criteria": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["id", "text", "state"], "properties": {"state": {"enum": ["pending", "satisfied", "waived"]}}}},
    },
}


def materialised(spark, cases):
    """{case: changes} as a tree, each with the dashboard that its records give, unless the case says otherwise."""
    from recordloom.plans import report
    from recordloom.sources import snapshot
    from recordloom.sources.records import Records

    repos, kept = {}, {}
    for name, changes in cases.items():
        changes = dict(changes)
        kept[name] = changes.pop("_dashboard", None)
        repos[name] = {k: v for k, v in (base() | changes).items() if v is not None}
    plain = Records(snapshot.from_texts(spark, repos))
    for r in report.dashboard(plain, AS_OF).collect():
        repos[r["repo_id"]][DASHBOARD] = r["dashboard"]
    for name, said in kept.items():
        if said == "remove":
            repos[name].pop(DASHBOARD, None)
        elif said:
            repos[name][DASHBOARD] = said
    return snapshot.from_texts(spark, repos)
