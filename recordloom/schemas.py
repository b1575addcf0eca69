"""JSON Schemas of the record kinds, as they are shipped: a repository's own schema files go before them."""

from __future__ import annotations

from recordloom.model import EVIDENCE_FIELDS, PROVENANCE, STATUSES, WORK_FIELDS


def _object(required: tuple[str, ...] = (), closed: bool = False, **properties) -> dict:
    out: dict = {"type": "object", "required": list(required), "properties": properties}
    return out | {"additionalProperties": False} if closed else out


def _list(items: dict, least: int = 0, unique: bool = False) -> dict:
    return {"type": "array", "items": items} | ({"minItems": least} if least else {}) | ({"uniqueItems": True} if unique else {})


def _text(pattern: str | None = None) -> dict:
    return {"type": "string", "pattern": pattern} if pattern else {"type": "string", "minLength": 1}


ANY = {"type": "string"}
_PROVENANCE = {"enum": list(reversed(PROVENANCE))}

# The fields, enumerations and patterns of the record formats.
_NUMBER, _SHA, _REPOSITORY = "^[0-9]{3,}$", "^[0-9a-f]{64}$", "^[^/]+/[^/]+$"
WORK = _object(
    WORK_FIELDS,
    id=_text(_NUMBER), title=_text(), status={"enum": list(STATUSES)}, owner_scope=_text(), affected_scopes=_list(ANY, unique=True), depends_on=_list(_text(_NUMBER), unique=True), provenance=_PROVENANCE,
    preflight=_object(("created_before_work_started", "created_at", "note"), created_before_work_started={"const": True}, created_at=ANY, note=_text()),
    acceptance_criteria=_list(_object(("id", "text", "state", "evidence"), id=ANY, text=ANY, state={"enum": ["pending", "satisfied", "waived"]}, evidence=_list(ANY), provenance=_PROVENANCE), least=1),
    created=ANY, updated=ANY,
)
EVIDENCE = _object(
    EVIDENCE_FIELDS,
    id=_text(), timestamp=ANY, work_item=_text(_NUMBER), result={"enum": ["passed", "failed", "partial", "blocked"]}, provenance=_PROVENANCE,
    commands=_list(_object(("command", "exit_code"), command=ANY, exit_code={"type": "integer"}, summary=ANY)), artifacts=_list(ANY), environment={"type": "object"},
)
FINDING = _object(
    ("id", "scope", "observed", "risk", "reconciliation", "state", "created"),
    id=_text(_NUMBER), scope=_text(), observed=_text(), risk={"enum": ["low", "medium", "high"]}, reconciliation=_text(), state={"enum": ["open", "reconciled", "accepted"]}, created=ANY,
)
_VERSION = {"type": "integer", "minimum": 1}
INVARIANTS = _object(
    ("version", "invariants"),
    version=_VERSION, invariants=_list(_object(("id", "statement", "rationale", "escalation", "enforced_by"), id=_text("^INV-[0-9]+$"), statement=_text(), rationale=_text(), escalation=_text(), enforced_by={"type": ["string", "null"]}), least=1),
)
FROZEN = _object(("version", "protected"), version=_VERSION, protected=_list(_object(("glob", "reason"), glob=_text(), reason=_text(), symbols=_list(ANY))))
_FILE = _object(
    ("upstream_path", "adopter_path", "mode", "upstream_sha256", "adopter_sha256"), True,
    upstream_path=_text(), adopter_path=_text(), mode={"enum": ["exact", "overlay"]}, upstream_sha256=_text(_SHA), adopter_sha256=_text(_SHA), overlay_path=_text(), overlay_sha256=_text(_SHA),
) | {"allOf": [{"if": {"properties": {"mode": {"const": "overlay"}}}, "then": {"required": ["overlay_path", "overlay_sha256"]}, "else": {"not": {"anyOf": [{"required": ["overlay_path"]}, {"required": ["overlay_sha256"]}]}}}]}
_PYPI = _object(("type", "package", "version_file"), True, type={"const": "pypi"}, package=_text(), version_file=_text())
_VENDORED = _object(("type", "version_file", "upstream_version", "upstream_revision", "files"), True, type={"const": "vendored"}, version_file=_text(), upstream_version=_text(r"^[0-9]+\.[0-9]+\.[0-9]+$"), upstream_revision=_text("^[0-9a-f]{40}$"), files=_list(_FILE, least=1))
ADOPTERS = _object(
    ("version", "upstream", "adopters"), True, **{"$schema": ANY}, version={"const": 1}, upstream=_object(("repository", "version_file"), True, repository=_text(_REPOSITORY), version_file=_text()),
    adopters=_list(_object(("id", "repository", "default_branch", "consumption", "validation_commands"), True, id=_text("^[a-z0-9][a-z0-9-]*$"), repository=_text(_REPOSITORY), default_branch=_text(), consumption={"oneOf": [_PYPI, _VENDORED]}, validation_commands=_list(_text(), least=1)), least=1),
)
#: By the kinds of integrity.SCHEMA_FILES.
SHIPPED = {"work": WORK, "evidence": EVIDENCE, "findings": FINDING, "invariants": INVARIANTS, "frozen": FROZEN, "adopters": ADOPTERS}
