"""First records for trees that have none: owners out of CODEOWNERS, workflows, versions, new records, missing files."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as t
from recordloom.sources.records import Records
from recordloom.sources.snapshot import text_lines


def code_owners(r: Records) -> DataFrame:
    """repo_id, handle and globs (each once, in order) of the first CODEOWNERS file; comments and ownerless lines aside."""
    rank = F.array_position(F.array(*map(F.lit, (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS"))), F.col("path"))
    first = r.files.withColumn("rank", rank).where("rank > 0").groupBy("repo_id").agg(F.min_by("path", "rank").alias("path"), F.min_by("text", "rank").alias("text"))
    words = F.split(F.trim(F.regexp_replace("line", "#.*$", "")), r"\s+")
    own = text_lines(first).select("repo_id", "pos", words.alias("w")).where("size(w) > 1").select("repo_id", "pos", F.col("w")[0].alias("glob"), F.explode(F.slice("w", 2, F.size("w"))).alias("handle"))
    own = own.groupBy("repo_id", "handle", "glob").agg(F.min("pos").alias("pos"))
    return own.groupBy("repo_id", "handle").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "glob"))), lambda x: x["glob"]).alias("globs"))


def workflows(r: Records) -> DataFrame:
    """repo_id, path and title of CI workflows: their first `name:`, else their file's name."""
    own = r.files.where(F.col("path").rlike(r"^\.github/workflows/[^/]+\.ya?ml\z"))
    said = F.regexp_replace(F.regexp_extract("text", r"(?m)^[ \t]*name:[ \t]*(\S.*?)[ \t]*$", 1), "^[\"']|[\"']$", "")
    return own.select("repo_id", "path", F.coalesce(F.nullif(said, F.lit("")), F.regexp_replace("name", r"\.[^.]*\z", "")).alias("title"))


def detected_version(r: Records, default: str = "0.1.0") -> DataFrame:
    """repo_id and version: VERSION, else the project file's, else the default."""
    own = r.text_of("VERSION", "a")
    project = r.one("pyproject.toml").select("repo_id", F.nullif(F.regexp_extract("text", r'(?m)^version\s*=\s*["\']([0-9]+\.[0-9]+\.[0-9]+)', 1), F.lit("")).alias("b"))
    sound = F.when(F.col("a").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\z"), F.col("a"))
    return r.repos.join(own, "repo_id", "left").join(project, "repo_id", "left").select("repo_id", F.coalesce(sound, "b", F.lit(default)).alias("version"))


def missing_files(wanted: DataFrame, r: Records) -> DataFrame:
    """wanted (repo_id, path, text) with `action`: create where there is no such file, else skip."""
    there = r.files.select("repo_id", "path", F.lit(True).alias("_t"))
    return wanted.join(there, ["repo_id", "path"], "left").select("repo_id", "path", "text", F.when(F.col("_t").isNull(), "create").otherwise("skip").alias("action"))


def next_ids(r: Records, kind: str) -> DataFrame:
    """repo_id and next_id of a kind of records: work (3 digits), decisions (4) or policies (3)."""
    width = {"work": 3, "decisions": 4, "policies": 3}[kind]
    name = r.manifest_files.select("repo_id", F.col("dir_name").alias("name")) if kind == "work" else getattr(r, kind).select("repo_id", "name")
    top = name.groupBy("repo_id").agg(F.max(F.regexp_extract("name", r"^(\d+)-", 1).try_cast("bigint")).alias("n"))
    n = (F.coalesce("n", F.lit(0)) + 1).cast("string")
    return r.repos.join(top, "repo_id", "left").select("repo_id", F.lpad(n, F.greatest(F.lit(width), F.length(n)), F.lit("0")).alias("next_id"))


def new_work_items(wanted: DataFrame, r: Records, as_of: str, status: str = "active") -> DataFrame:
    """Manifests and narratives (path, text) for titles (repo_id, title), one for each repository."""
    own = wanted.join(next_ids(r, "work"), "repo_id")
    criterion = F.struct(F.lit("AC-1").alias("id"), F.lit("Describe the outcome.").alias("text"), F.lit("pending").alias("state"), F.array().cast("array<string>").alias("evidence"))
    mark = F.struct(F.lit(True).alias("created_before_work_started"), F.lit(as_of).alias("created_at"), F.lit("Written before work began.").alias("note"))
    none = F.array().cast("array<string>")
    record = F.struct(F.array(criterion).alias("acceptance_criteria"), none.alias("affected_scopes"), F.lit(as_of).alias("created"), none.alias("depends_on"), F.col("next_id").alias("id"), F.lit("governance").alias("owner_scope"), mark.alias("preflight"), F.lit(status).alias("status"), "title", F.lit(as_of).alias("updated"))
    at = F.concat(F.lit(f"work/{status}/"), "next_id", F.lit("-"), t.slug("title"))
    narrative = F.concat(F.lit("# "), "title", F.lit("\n\n- [ ] **AC-1** Describe the outcome.\n"))
    files = F.array(F.struct(F.concat(at, F.lit("/work-item.json")).alias("path"), F.to_json(record).alias("text")), F.struct(F.concat(at, F.lit("/README.md")).alias("path"), narrative.alias("text")))
    return own.select("repo_id", F.explode(files).alias("f")).select("repo_id", "f.path", "f.text")


def report_counts(planned: DataFrame) -> DataFrame:
    """repo_id and how many files of each kind of record are created, and how many skipped."""
    made = F.col("action") == "create"
    kinds = {"work_items": r"^work/.+/work-item\.json\z", "decisions": "^decisions/", "findings": "^audits/findings/"}
    return planned.groupBy("repo_id").agg(*(F.count_if(made & F.col("path").rlike(p)).alias(k) for k, p in kinds.items()), F.count_if(~made).alias("skipped"))




def bootstrap_files(as_of: str, version: str = "0.1.0", days: int = 90) -> dict[str, str]:
    """The files of an empty sound repository, without its dashboard: {path: text}."""
    due = (datetime.date.fromisoformat(as_of) + datetime.timedelta(days=days)).isoformat()
    text = lambda x: json.dumps(x, indent=2, sort_keys=True) + "\n"
    return {
        "VERSION": f"{version}\n",
        "AGENTS.md": "# Contract\n\nRecords here are the source of truth; reports are generated from them.\n",
        "governance/owners.json": text({"scopes": [{"id": "governance", "paths": ["**"], "owner": "maintainers"}], "roles": [], "preflight": {"enabled": True}}),
        "governance/invariants.json": text({"version": 1, "invariants": [{"id": "INV-1", "statement": "Records are the source of truth; reports are generated from them.", "rationale": "A report that is edited tells nothing of the records.", "escalation": "Ask the maintainers.", "enforced_by": None}]}),
        "governance/frozen-surface.json": text({"version": 1, "protected": []}),
        "audits/registry.json": text({"scopes": [{"path": ".", "owner": "maintainers", "contract": "AGENTS.md", "last_reviewed": as_of, "next_review": due, "alignment": "aligned", "notes": ""}]}),
    }


def bootstrap(repos: DataFrame, as_of: str) -> DataFrame:
    """repo_id, path and text of the files that new repositories (repo_id) begin with."""
    files = repos.sparkSession.createDataFrame(list(bootstrap_files(as_of).items()), "path string, text string")
    return repos.select("repo_id").distinct().crossJoin(F.broadcast(files))
