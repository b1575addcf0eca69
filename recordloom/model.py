"""Constants and relations of record repositories."""

from __future__ import annotations

#: States of work items, in their order; other enumerations; parts of a path that hide what is below.
STATUSES = ("proposed", "active", "blocked", "deferred", "completed")
DECISION_STATUSES = ("proposed", "accepted", "rejected", "deferred", "superseded", "deprecated")
POLICY_STATUSES = ("active", "retired")
PROVENANCE = ("inferred", "provisional", "concrete")
IGNORED_PARTS = (".git", "__pycache__", "node_modules", ".venv", ".pytest_cache", "build", "dist", "fixtures", "worktrees")
WORK_FIELDS = ("id", "title", "status", "owner_scope", "affected_scopes", "depends_on", "acceptance_criteria", "created", "updated")
EVIDENCE_FIELDS = ("id", "timestamp", "work_item", "result", "commands", "artifacts", "environment")
AUDIT_FILES = ("README.md", "inventory.md", "alignment-report.md")

#: The fields of the record formats, as Spark schemas; TREE is our own.
TREE = "repo_id string, path string, content binary, is_dir boolean"
WORK_ITEM = """id string, title string, status string, owner_scope string, affected_scopes array<string>, depends_on array<string>, provenance string,
preflight struct<created_before_work_started: boolean, created_at: string, note: string>,
acceptance_criteria array<struct<id: string, text: string, state: string, evidence: array<string>, provenance: string>>, created string, updated string, source string"""
EVIDENCE = "id string, timestamp string, work_item string, result string, provenance string, commands array<struct<command: string, exit_code: bigint, summary: string>>, artifacts array<string>, source string"
FINDING = "id string, scope string, observed string, risk string, reconciliation string, state string, created string, source string"
INVARIANTS = "version bigint, invariants array<struct<id: string, statement: string, rationale: string, escalation: string, enforced_by: string>>"
FROZEN = "version bigint, protected array<struct<glob: string, reason: string, symbols: array<string>>>"
OWNERS = """scopes array<struct<id: string, paths: array<string>, owner: string>>, roles array<struct<id: string, description: string, scopes: array<string>>>,
concurrency struct<enforce_disjoint_active_scopes: boolean>, preflight struct<enabled: boolean, required_from_id: string, required_from_date: string>, enforce_tracked_path_ownership boolean"""
REGISTRY = "scopes array<struct<path: string, owner: string, contract: string, last_reviewed: string, next_review: string, alignment: string, notes: string>>"
ADOPTERS = """version bigint, upstream struct<repository: string, package: string>, adopters array<struct<id: string, repository: string, default_branch: string, validation_commands: array<string>,
consumption: struct<type: string, package: string, version_file: string, upstream_version: string, upstream_revision: string,
files: array<struct<mode: string, upstream_path: string, adopter_path: string, upstream_sha256: string, adopter_sha256: string, overlay_path: string, overlay_sha256: string>>>>>"""
