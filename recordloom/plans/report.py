"""Reports derived from records: the dashboard, the record catalog, generated blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom import model
from recordloom.functions import text as t
from recordloom.operators import relational as ops
from recordloom.sources.records import Records

METRICS = ("Invariants", "Frozen-surface entries", "Scope contracts", "Audit registry entries", "Audit findings", "Decision records", "Policy records", "Evidence runs")


def status_counts(r: Records) -> DataFrame:
    """repo_id, status and n for every state of every repository, 0 included."""
    states = r.repos.select("repo_id", F.explode(F.array(*map(F.lit, model.STATUSES))).alias("status"))
    return ops.zero_filled(r.items.select("repo_id", "status"), states, ["repo_id", "status"])


def metrics(r: Records) -> DataFrame:
    """repo_id, metric and n: files of a kind are counted whether they can be read or not, evidence by distinct ids."""
    files = lambda name, condition: r.files.where(condition).select("repo_id", F.lit(name).alias("metric"))
    inside = lambda name, df, column: df.select("repo_id", F.lit(name).alias("metric"), F.explode(column)).select("repo_id", "metric")
    notes = (F.col("name").endswith(".md")) & (F.upper("name") != "README.MD")
    rows = ops.union_all([
        inside("Invariants", r.invariants, "data.invariants"), inside("Frozen-surface entries", r.frozen, "data.protected"),
        r.contracts.select("repo_id", F.lit("Scope contracts").alias("metric")), inside("Audit registry entries", r.registry, "data.scopes"),
        files("Audit findings", (F.col("parent") == "audits/findings") & F.col("name").endswith(".json")),
        files("Decision records", (F.col("parent") == "decisions") & notes), files("Policy records", (F.col("parent") == "governance/policies") & notes),
        r.evidence.select("repo_id", "id").distinct().select("repo_id", F.lit("Evidence runs").alias("metric")),
    ])
    return ops.zero_filled(rows, r.repos.select("repo_id", F.explode(F.array(*map(F.lit, METRICS))).alias("metric")), ["repo_id", "metric"])


def overdue(r: Records, as_of: str) -> DataFrame:
    """Audit scopes whose next review is before as_of; entries without a date are passed over."""
    late = t.is_date(F.coalesce("next_review", F.lit(""))) & (F.col("next_review").try_cast("date") < F.lit(as_of).cast("date"))
    return r.audit_scopes.where(late).select("repo_id", "pos", F.coalesce("scope", F.lit("")).alias("scope"), "next_review")


def shown_version(r: Records) -> DataFrame:
    """repo_id and version: the first of the version files, `unknown` without any."""
    found = r.files.where(F.col("path").isin("scripts/SPEC_VERSION", "VERSION")).select("repo_id", F.when(F.col("path") == "VERSION", 2).otherwise(1).alias("rank"), F.trim(F.regexp_replace("text", r"^\s+|\s+\z", "")).alias("v"))
    return r.repos.join(found.groupBy("repo_id").agg(F.min_by("v", "rank").alias("v")), "repo_id", "left").select("repo_id", F.coalesce("v", F.lit("unknown")).alias("version"))


def _listed(rows: DataFrame, order: str | Column, line: Column, name: str) -> DataFrame:
    """The lines of a repository, in order, as one text."""
    order = F.col(order) if isinstance(order, str) else order
    own = rows.select("repo_id", F.struct(order.alias("o"), line.alias("l")).alias("x")).groupBy("repo_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return own.select("repo_id", F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias(name))


def dashboard(r: Records, as_of: str) -> DataFrame:
    """repo_id and dashboard: the text that the records give; repositories whose sources can't be read have none."""
    rank = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    row = lambda a, b: F.concat(F.lit("| "), F.col(a), F.lit(" | "), F.col(b).cast("string"), F.lit(" |"))
    health = _listed(metrics(r), rank(METRICS, "metric"), row("metric", "n"), "health")
    states = _listed(status_counts(r), rank(model.STATUSES, "status"), row("status", "n"), "states")
    late = _listed(overdue(r, as_of), "pos", row("scope", "next_review"), "late")
    busy = r.items.where("status in ('active', 'blocked')")
    busy = _listed(busy, F.struct("ord.s", "ord.p"), F.concat(F.lit("- "), "id", F.lit(": "), F.coalesce("data.title", F.lit("None")), F.lit(" ("), "status", F.lit(")")), "busy")
    readable = r.repos.join(r.broken, "repo_id", "left_anti")
    for df in (r.registry, r.invariants, r.frozen):
        readable = readable.join(df.where("keys is not null").select("repo_id"), "repo_id", "left_semi")
    own = readable.join(shown_version(r), "repo_id").join(health, "repo_id").join(states, "repo_id").join(late, "repo_id", "left").join(busy, "repo_id", "left")
    lit = F.lit
    text = F.concat(
        lit("# Repository Dashboard\n\n> Canonically generated from source records. Do not edit manually.\n> Validation fails when this file differs from the generated text.\n> Spec version: "), "version",
        lit("\n\n## Health\n\n| Metric | Count |\n| --- | ---: |\n"), "health", lit("\n\n## Work\n\n| Status | Count |\n| --- | ---: |\n"), "states",
        lit("\n\n## Audit freshness\n\n"), F.coalesce(F.concat(lit("| Scope | Review was due |\n| --- | --- |\n"), "late"), lit("All audit scopes are within their review cadence.")),
        lit("\n\n## Active items\n\n"), F.coalesce("busy", lit("No active or blocked work.")), lit("\n"),
    )
    return own.select("repo_id", text.alias("dashboard"))


def invariant_table(r: Records) -> DataFrame:
    """repo_id and block: the invariants as a Markdown table."""
    each = r.invariants.select("repo_id", F.posexplode("data.invariants").alias("pos", "i"))
    by = F.when(F.coalesce("i.enforced_by", F.lit("")) == "", F.lit("human review (escalation)")).otherwise(F.col("i.enforced_by"))
    own = _listed(each, "pos", F.concat(F.lit("| "), F.col("i.id"), F.lit(" | "), F.col("i.statement"), F.lit(" | "), by, F.lit(" |")), "rows")
    return own.select("repo_id", F.concat(F.lit("| ID | Statement | Enforced by |\n| --- | --- | --- |\n"), "rows").alias("block"))


def catalog(schemas: DataFrame) -> DataFrame:
    """block: a Markdown table of record kinds, from (pos, record, location, file, text of its schema)."""
    required = F.transform(F.from_json("text", "required array<string>")["required"], lambda x: F.concat(F.lit("`"), x, F.lit("`")))
    listed = F.when(F.size(required) > 0, F.array_join(required, ", ")).otherwise(F.lit("—"))
    line = F.concat(F.lit("| "), "record", F.lit(" | `"), "location", F.lit("` | `"), "file", F.lit("` | "), listed, F.lit(" |"))
    own = _listed(schemas.withColumn("repo_id", F.lit("")), "pos", line, "rows")
    return own.select(F.concat(F.lit("| Record | Location | Schema | Required fields |\n| --- | --- | --- | --- |\n"), "rows").alias("block"))


def replace_block(text: Column, name: str, content: Column) -> Column:
    """text with what stands between the block's two comment markers replaced; null if it has no such markers."""
    start, end = f"<!-- generated:{name} -->\n", f"\n<!-- /generated:{name} -->"
    a = F.instr(text, F.lit(start))
    b = F.instr(text, F.lit(end))
    return F.when((a > 0) & (b > a), F.concat(F.substring(text, F.lit(1), a + len(start) - 1), content, F.substring(text, b, F.length(text))))


def as_json(columns: dict[str, Column]) -> Column:
    """A struct as JSON with its keys in sorted order."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})
