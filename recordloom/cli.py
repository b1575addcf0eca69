"""Commands over folders of records.

validate, dashboard, doctor, plan, retire, changed, owners and next-id read repositories; init, adopt and new tell, or write,
files that aren't there yet; fleet-verify and release-closeout compare adopters with tables of what their remotes hold; spec
prints the catalog of record kinds; conformance checks a folder of cases. Tracked and ignored files are read from a checkout's
index and ignore files, unless lists of them are given; what else version control or a remote knows comes in
files: lists of paths, one in a line, or JSON lines of the tables that the plans name.
"""

from __future__ import annotations

import argparse
import datetime
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom import schemas
from recordloom.operators import history
from recordloom.plans import adoption, change, doctor, fleet, integrity, planning, report
from recordloom.sources import files, snapshot, version_control
from recordloom.sources.records import Records

COMMANDS = ("validate", "dashboard", "doctor", "plan", "retire", "changed", "owners", "next-id", "init", "adopt", "new", "fleet-verify", "release-closeout", "spec", "conformance")
#: Tables of the remotes as Spark schemas, and where records of a kind lie.
_HEADS, _FILES, _CLONES = "repository string, branch string, head string", "repository string, revision string, path string, content binary", "url string, path string, marked boolean"
_PACKAGE, _GIT = "repo_id string, result string, release string, url string, artifacts array<string>", "repo_id string, folder string, tracked boolean, clean boolean, head string"
_PLACES = {"work": "work/<status>/<id>-<slug>/work-item.json", "evidence": "evidence/runs/<id>.json", "findings": "audits/findings/<id>-<slug>.json", "invariants": "governance/invariants.json", "frozen": "governance/frozen-surface.json", "adopters": "governance/adopters.json"}


def _lines(spark: SparkSession, roots: list[str], file: str | None) -> DataFrame:
    """repo_id and path of a list of paths, the same for each root."""
    paths = [x for x in Path(file).read_text().split("\n") if x] if file else []
    return spark.createDataFrame([(root, x) for root in roots for x in paths], "repo_id string, path string")


def _table(spark: SparkSession, file: str | None, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(file) if file else spark.createDataFrame([], schema)


def _ignored(spark: SparkSession, r: Records, roots: list[str]) -> DataFrame:
    """Files of the repositories that their .gitignore files hide, which Spark's readers pass over as hidden themselves."""
    own = [(root, str(x.relative_to(root)), x.read_bytes()) for root in roots for x in sorted(Path(root).rglob(".gitignore")) if ".git" not in x.relative_to(root).parts[:-1]]
    patterns = version_control.ignore_patterns(spark.createDataFrame(own, "repo_id string, path string, content binary"))
    return version_control.ignored(r.files, patterns, version_control.tracked(version_control.load_indexes(spark, {root: root for root in roots})))


def _put(rows: DataFrame, action: str) -> None:
    """Writes rows (repo_id, path, text) below their repositories' folders, as one transaction."""
    root = F.when(F.startswith("repo_id", F.lit("/")), F.col("repo_id")).otherwise(F.concat(F.lit(f"{Path.cwd()}/"), "repo_id"))
    files.write_files(rows.select(root.alias("repo_id"), "path", F.encode("text", "UTF-8").alias("content"), F.lit(action).alias("action")))


def _made(rows: DataFrame, write: bool) -> list[str]:
    """Lines of missing_files(); with write, files to be created are written, unless there are some by then."""
    lines = [f"{x.repo_id}: {x.action} {x.path}" for x in rows.select("repo_id", "action", "path").orderBy("repo_id", "path").collect()]
    if write:
        _put(rows.where("action = 'create'"), "create")
    return lines


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if nothing is wrong, 1 if there are problems, findings or hits."""
    parser = argparse.ArgumentParser(prog="recordloom", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--root", action="append", default=[], help="folder of a repository; may be given several times")
    parser.add_argument("--as-of", default=datetime.date.today().isoformat())
    parser.add_argument("--write", action="store_true", help="dashboard, init, adopt, new: write the files that aren't there")
    parser.add_argument("--tracked", help="validate: file of paths under version control, in place of the index of each repository")
    parser.add_argument("--ignored", help="doctor: file of paths that version control ignores, in place of the repositories' .gitignore files")
    parser.add_argument("--log", help=f"adopt: file of `git log --all --format={version_control.LOG_FORMAT}`, for statistics of the history".replace("%", "%%"))
    parser.add_argument("--git", help="retire: JSON lines of what version control knows of plan folders")
    parser.add_argument("--issues", help="plan: JSON lines of issues")
    parser.add_argument("--changed", help="changed: file of changed paths")
    parser.add_argument("--patch", help="changed: file of the change's unified diff")
    parser.add_argument("--title", help="new: title of the work item")
    for name in ("heads", "files", "checkouts", "package"):
        parser.add_argument(f"--{name}", help="fleet-verify, release-closeout: JSON lines of this table")
    args = parser.parse_args(argv)
    if not args.root and args.command != "spec":
        parser.error("--root is required")
    spark = spark or SparkSession.builder.appName("recordloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "spec":
        rows = [(k, kind, _PLACES[kind], integrity.SCHEMA_FILES[kind], json.dumps(schema)) for k, (kind, schema) in enumerate(schemas.SHIPPED.items())]
        print(report.catalog(spark.createDataFrame(rows, "pos int, record string, location string, file string, text string")).first()["block"])
        return 0
    roots = {Path(x).name: x for root in args.root for x in sorted(map(str, Path(root).iterdir())) if Path(x).is_dir()} if args.command == "conformance" else {root: root for root in args.root}
    for root in args.root if args.command == "init" else ():
        Path(root).mkdir(parents=True, exist_ok=True)
    tracked = _lines(spark, args.root, args.tracked) if args.tracked else version_control.tracked(version_control.load_indexes(spark, roots)) if args.command == "validate" else None
    r = Records(snapshot.load(spark, roots), tracked.select("repo_id", "path") if tracked is not None else None)
    repos = spark.createDataFrame([(x,) for x in roots], "repo_id string")
    lines, bad = [], False
    if args.command == "validate":
        lines = [f"ERROR {x.repo_id} {x.path}: {x.message}" for x in integrity.ordered(integrity.validate(r, args.as_of, schemas.SHIPPED)).collect()]
        bad = bool(lines)
        lines.append(f"Validation failed with {len(lines)} error(s)." if bad else "Validation passed.")
    elif args.command == "dashboard":
        made = report.dashboard(r, args.as_of)
        lines = [x.dashboard for x in made.collect()]
        if args.write:
            _put(made.select("repo_id", F.lit("audits/reports/dashboard.md").alias("path"), F.col("dashboard").alias("text")), "replace")
    elif args.command == "doctor":
        shipped = spark.createDataFrame([(integrity.SCHEMA_FILES[kind], json.dumps(x, indent=2).encode()) for kind, x in schemas.SHIPPED.items()], "name string, content binary")
        found = doctor.diagnose(r, shipped, _lines(spark, args.root, args.ignored) if args.ignored else _ignored(spark, r, args.root)).persist()
        lines = [f"{x.severity} {x.code} {x.repo_id}: {x.message}" for x in found.orderBy("repo_id", "code", "message").collect()]
        lines += [f"repair {x.repo_id}: {x.action} {x.subject or ''}".rstrip() for x in doctor.repairs(r, args.as_of, found).orderBy("repo_id", "action").collect()]
        bad = not found.isEmpty()
    elif args.command == "plan":
        issues = _table(spark, args.issues, "repo_id string, number bigint, title string, body string, state string, url string") if args.issues else None
        lines = [f"{x.repo_id}: {x.source} -> {x.home} ({x.criterion_state})" for x in planning.planned(r, issues).orderBy("repo_id", "rank", "ord").collect()]
    elif args.command == "retire":
        lines = [f"{x.repo_id}: {x.action} {x.folder} ({x.reason})" for x in planning.retirement(r, _table(spark, args.git, _GIT)).collect()]
        bad = any(": block " in x for x in lines)
    elif args.command == "changed":
        patch = Path(args.patch).read_text() if args.patch else ""
        patches = spark.createDataFrame([(root, "patch", patch) for root in args.root], "repo_id string, path string, text string")
        lines = [f"{x.repo_id}: {x.hit} is protected: {x.reason}" for x in change.violations(r, _lines(spark, args.root, args.changed), patches).orderBy("repo_id", "hit").collect()]
        bad = bool(lines)
    elif args.command == "owners":
        lines = [f"{x.repo_id}: {x.handle} {' '.join(x.globs)}" for x in adoption.code_owners(r).orderBy("repo_id", "handle").collect()]
    elif args.command in ("init", "adopt"):
        if args.command == "adopt":
            lines = [f"{x.repo_id}: version {x.version}" for x in adoption.detected_version(r).orderBy("repo_id").collect()]
            lines += [f"{x.repo_id}: owner {x.handle} {' '.join(x.globs)}" for x in adoption.code_owners(r).orderBy("repo_id", "handle").collect()]
            if args.log:
                found = history.statistics(*version_control.log_tables(_lines(spark, args.root, args.log).withColumnRenamed("path", "line")))
                lines += [f"{x.repo_id}: {x.commits} commits by {x.contributors}, head {x.head}, latest tag {x.latest_tag}" for x in found.orderBy("repo_id").collect()]
            lines += [f"{x.repo_id}: workflow {x.title}" for x in adoption.workflows(r).orderBy("repo_id", "path").collect()]
        lines += _made(adoption.missing_files(adoption.bootstrap(repos, args.as_of), r), args.write)
    elif args.command == "new":
        wanted = repos.withColumn("title", F.lit(args.title or "Untitled"))
        lines = _made(adoption.missing_files(adoption.new_work_items(wanted, r, args.as_of), r), args.write)
    elif args.command in ("fleet-verify", "release-closeout"):
        verified = fleet.verify(r, _table(spark, args.heads, _HEADS), _table(spark, args.files, _FILES), _table(spark, args.checkouts, _CLONES)).persist()
        if args.command == "fleet-verify":
            lines = [f"{'ok' if x.ok else 'ERROR'} {x.repository}: {'; '.join(x.errors or x.checks)}" for x in verified.collect()]
            bad = not lines or not all(x.ok for x in fleet.fleet_ok(verified).collect())
        else:
            found = fleet.closeout(r, verified, _table(spark, args.package, _PACKAGE)).collect()
            lines = [f"{x.repo_id}: {'; '.join(x.errors) or 'complete'}" for x in found]
            bad = any(x.errors for x in found)
    elif args.command == "conformance":
        meta = r.files.where("path = 'meta.json'").select("repo_id", F.from_json("text", "expect string, fragment string").alias("m")).select("repo_id", "m.expect", F.coalesce("m.fragment", F.lit("")).alias("fragment"))
        found = integrity.verdicts(meta, r, integrity.validate(r, args.as_of, schemas.SHIPPED)).orderBy("case").collect()
        lines = [f"{'ok' if x.passed else 'FAILED'} {x.case}: {x.n_problems} problem(s)" for x in found]
        bad = not all(x.passed for x in found)
    else:
        lines = [f"{x.repo_id}: {kind} {x.next_id}" for kind in ("work", "decisions", "policies") for x in adoption.next_ids(r, kind).collect()]
    r.release()
    print("\n".join(lines))
    return int(bad)


if __name__ == "__main__":
    raise SystemExit(main())
