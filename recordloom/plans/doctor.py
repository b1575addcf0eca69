"""Diagnoses of repositories and the repairs that would mend them, as rows; nothing is changed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import model
from recordloom.functions import text as t
from recordloom.operators import relational as ops
from recordloom.plans.integrity import say
from recordloom.sources.records import Records


def _finding(rows: DataFrame, severity: str, code: str, message: Column | str, fixable: bool, subject: str | Column | None = None) -> DataFrame:
    message = F.lit(message) if isinstance(message, str) else message
    subject = F.col(subject) if isinstance(subject, str) else F.lit(None).cast("string") if subject is None else subject
    return rows.select("repo_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"), F.lit(fixable).alias("fixable"), subject.alias("subject"))


def schema_skew(r: Records, shipped: DataFrame) -> DataFrame:
    """Shipped schemas (name, content) that a repository lacks, or has otherwise."""
    own = r.files.where("parent = 'schemas'").select("repo_id", "name", F.sha2("content", 256).alias("mine"))
    both = r.repos.crossJoin(F.broadcast(shipped.select("name", F.sha2("content", 256).alias("theirs")))).join(own, ["repo_id", "name"], "left")
    return _finding(both.where("mine is null"), "warn", "schema-missing", say("schema ", F.col("name"), " is missing"), True, "name").unionByName(
        _finding(both.where("mine <> theirs"), "warn", "schema-differs", say("schema ", F.col("name"), " differs from the shipped one; review by hand"), False, "name"))


def stale_registry(r: Records) -> DataFrame:
    """Registry entries whose path or contract isn't there."""
    at = F.when(F.col("scope") == ".", F.lit(".")).otherwise(t.normal_path(F.coalesce("scope", F.lit("None"))))
    own = r.audit_scopes.withColumns({"at": at, "file": t.normal_path(F.coalesce("contract", F.lit("")))})
    own = own.join(r.tree.select("repo_id", F.col("path").alias("at"), F.lit(True).alias("has_path")).distinct(), ["repo_id", "at"], "left")
    own = own.join(r.files.select("repo_id", F.col("path").alias("file"), F.lit(True).alias("has_file")), ["repo_id", "file"], "left")
    bad = own.where(F.col("has_path").isNull() | ((F.coalesce("contract", F.lit("")) != "") & F.col("has_file").isNull()))
    return _finding(bad, "error", "registry-stale", say("registry scope '", F.col("scope"), "' points at a path/contract that does not exist"), True, "scope")


def missing_root_contract(r: Records) -> DataFrame:
    return _finding(r.repos.join(r.one("AGENTS.md").select("repo_id"), "repo_id", "left_anti"), "error", "no-root-contract", "root AGENTS.md is missing (required contract)", True)


def unregistered_contracts(r: Records) -> DataFrame:
    loose = r.contracts.where("parent <> '.'").join(r.covered, ["repo_id", "parent"], "left_anti")
    return _finding(loose, "error", "contract-unregistered", say("nested contract ", F.col("path"), " is not registered in audits/registry.json"), True, "path")


def incomplete_audits(r: Records) -> DataFrame:
    audits = r.tree.where("is_dir and name = '_audit'").select("repo_id", "parent", F.col("path").alias("audit"))
    wanted = r.contracts.join(audits, ["repo_id", "parent"]).select("repo_id", F.explode(F.array(*(F.concat("audit", F.lit(f"/{x}")) for x in model.AUDIT_FILES))).alias("path"))
    return _finding(ops.dangling(wanted, r.files, ["repo_id", "path"]), "error", "audit-incomplete", say("incomplete _audit companion: missing ", F.col("path")), True, "path")


def ignored_records(r: Records, ignored: DataFrame) -> DataFrame:
    """Records among the paths (repo_id, path) that version control ignores."""
    own = r.files.where(F.col("path").rlike(r"^(governance/.+|schemas/[^/]+|evidence/runs/[^/]+\.json|audits/.+|decisions/[^/]+|work/.+)\z")).join(ignored.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    return _finding(own, "warn", "gitignored-record", say("governance record is git-ignored (missing on clone/CI): ", F.col("path")), True, "path")


def dead_pointers(r: Records) -> DataFrame:
    """source_of_truth values of front matter that name paths which aren't there; prose is passed over."""
    notes = r.files.where(F.col("path").rlike(r"^(work/.+\.md|decisions/[^/]+\.md|governance/.+\.md|audits/.+\.md|[^/]+\.md)\z") & F.startswith("text", F.lit("---")))
    block = F.regexp_extract("text", r"(?s)\A---(.*?)\n---", 1)
    lines = notes.select("repo_id", "path", F.explode(t.lines(block)).alias("line")).where(F.trim("line").startswith("source_of_truth:"))
    tokens = lines.select("repo_id", "path", F.explode(F.transform(F.split(F.regexp_replace("line", "^[^:]*:", ""), ";"), lambda x: F.trim(x))).alias("token"))
    tokens = tokens.where((F.col("token") != "") & ~F.contains("token", F.lit(" ")) & F.col("token").rlike(r"/|\.(md|json)\z")).withColumn("at", t.normal_path("token"))
    lost = tokens.join(r.tree.select("repo_id", F.col("path").alias("at")), ["repo_id", "at"], "left_anti")
    return _finding(lost, "warn", "source-of-truth-stale", say(F.col("path"), ": source_of_truth points at missing path '", F.col("token"), "'"), False, "path")


def diagnose(r: Records, shipped: DataFrame | None = None, ignored: DataFrame | None = None) -> DataFrame:
    frames = [stale_registry(r), missing_root_contract(r), unregistered_contracts(r), incomplete_audits(r), dead_pointers(r)]
    frames += [schema_skew(r, shipped)] if shipped is not None else []
    return ops.union_all(frames + ([ignored_records(r, ignored)] if ignored is not None else []))


def preflight_epoch(r: Records, as_of: str) -> DataFrame:
    """Repositories whose owners file has no preflight key, and the setting that they would get."""
    bare = r.owners.where("keys is not null and not array_contains(keys, 'preflight')")
    return bare.select("repo_id", "path", F.lit("preflight").alias("key"), F.to_json(F.struct(F.lit(True).alias("enabled"), F.lit(as_of).alias("required_from_date"))).alias("value"))


def ratchet(r: Records) -> DataFrame:
    """Provisional items whose satisfied criteria rest on concrete evidence alone (vacuously, with none): to concrete."""
    own = r.items.where("data.provenance = 'provisional'").select("repo_id", "path", "id")
    linked = r.criteria.where("state = 'satisfied'").select("repo_id", "path", F.explode("linked").alias("evidence")).join(r.evidence_provenance, ["repo_id", "evidence"], "left")
    soft = linked.where(F.coalesce("level", F.lit("concrete")) != "concrete").select("repo_id", "path").distinct()
    return own.join(soft, ["repo_id", "path"], "left_anti").select("repo_id", "path", "id", F.lit("concrete").alias("provenance"))


def repairs(r: Records, as_of: str, found: DataFrame) -> DataFrame:
    """repo_id, action and subject of what mends the fixable findings, the missing preflight epochs and the ratchets."""
    actions = {"schema-missing": "add schema", "registry-stale": "drop registry entry", "no-root-contract": "add root contract", "contract-unregistered": "register contract", "audit-incomplete": "add audit stub", "gitignored-record": "negate ignore pattern"}
    table = F.create_map(*(F.lit(x) for pair in actions.items() for x in pair))
    mended = found.where("fixable").select("repo_id", F.try_element_at(table, F.col("code")).alias("action"), "subject")
    epochs = preflight_epoch(r, as_of).select("repo_id", F.lit("set preflight epoch").alias("action"), F.col("value").alias("subject"))
    return ops.union_all([mended, epochs, ratchet(r).select("repo_id", F.lit("ratchet to concrete").alias("action"), F.col("path").alias("subject")), r.repos.select("repo_id", F.lit("generate dashboard").alias("action"), F.lit(None).cast("string").alias("subject"))])
