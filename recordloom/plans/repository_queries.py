"""The rules on single files of a repository, over one small repository for each supplier, and the same rows in DuckDB's SQL.

What a repository holds follows from its number `k`; its files are expressions of it, and the SQL tells by `k` alone what the
rules must find. Rules on work, criteria and evidence are in record_queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans import adoption, change, doctor, integrity, planning, report
from recordloom.plans.record_queries import _records
from recordloom.sources.records import Records
from recordloom.sources.stored import spread

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
AS_OF = "2000-06-01"
#: Columns of a repository, read by both engines.
_BASE = {
    "k": "s_suppkey",
    "repo_id": "concat('q', s_suppkey)",
    "v": "CASE WHEN s_suppkey % 5 = 0 THEN 'v1' ELSE concat('1.', s_suppkey % 7, '.0') END",
    "due": "CASE s_suppkey % 4 WHEN 0 THEN '2000-05-01' WHEN 1 THEN '1999-01-01' ELSE '2000-09-01' END",
}
_FRONT = "concat('---\\nid: ', {id}, '\\ntitle: ', {title}, '\\nstatus: ', {status}, '\\n{more}---\\n')"
_SCOPE = "concat('{{\"path\": \"', {path}, '\", \"contract\": \"', {contract}, '\", \"last_reviewed\": \"2000-01-01\", \"next_review\": \"', {due}, '\"}}')"
#: Texts of files by their paths; where the text is null, there is no file.
FILES = {
    "VERSION": "CASE WHEN k % 11 <> 0 THEN concat(v, '\\n') END",
    "RELEASE_LABEL": "CASE k % 4 WHEN 1 THEN concat(v, '-rc.1\\n') WHEN 2 THEN '9.9.9-rc.1\\n' WHEN 3 THEN 'rc1\\n' END",
    "README.md": "CASE WHEN k % 3 = 0 THEN '# None\\n' ELSE concat('# It\\n\\nThe current release **', CASE WHEN k % 3 = 1 THEN v ELSE '0.0.1' END, '**', CASE k % 7 WHEN 1 THEN ' ([log](https://x.org/c))' WHEN 2 THEN ' ([log](../out.md))' WHEN 3 THEN ' ([log](gone.md))' WHEN 4 THEN ' ([log](decisions/0001-first.md))' WHEN 5 THEN ' ([log](LICENSE))' ELSE '' END, '.\\n') END",
    "LICENSE": "'free\\n'",
    "AGENTS.md": "CASE WHEN k % 13 <> 0 THEN '# Contract\\n' END",
    "lib/AGENTS.md": "CASE WHEN k % 6 = 0 THEN '# Lib\\n' END",
    "lib/_audit/README.md": "CASE WHEN k % 18 = 0 THEN '# Audit\\n' END",
    "governance/invariants.json": "CASE WHEN k % 17 = 0 THEN NULL WHEN k % 17 = 1 THEN '[1]' ELSE concat('{\"version\": 1, \"invariants\": [{\"id\": \"I1\", \"statement\": \"s\", \"rationale\": \"', CASE WHEN k % 5 = 0 THEN ' ' ELSE 'r' END, '\", \"escalation\": \"e\"}, {\"id\": \"', CASE WHEN k % 9 = 0 THEN 'I1' ELSE 'I2' END, '\", \"statement\": \"t\", \"rationale\": \"r\", \"enforced_by\": \"x\"}]}') END",
    "governance/frozen-surface.json": "CASE WHEN k % 19 = 0 THEN NULL ELSE concat('{\"version\": 1, \"protected\": [{\"glob\": \"src/*.py\", \"reason\": \"', CASE WHEN k % 4 = 0 THEN ' ' ELSE 'core' END, '\", \"symbols\": [\"keep_me\"]}, {\"glob\": \"docs/\", \"reason\": \"told\"}]}') END",
    "governance/owners.json": "CASE WHEN k % 23 = 0 THEN NULL ELSE concat('{\"scopes\": [{\"id\": \"a\", \"paths\": [\"src/*\", \"lib/*\"]}, {\"id\": \"', CASE WHEN k % 7 = 0 THEN 'a' ELSE 'b' END, '\", \"paths\": [', CASE WHEN k % 8 = 0 THEN '' ELSE '\"docs/*\", \"src/x*\"' END, ']}], \"roles\": [{\"id\": \"keeper\", \"scopes\": [\"a\", \"', CASE WHEN k % 3 = 0 THEN 'zz' ELSE 'a' END, '\"]}]', CASE WHEN k % 5 = 0 THEN '' ELSE ', \"preflight\": {\"enabled\": true}' END, ', \"enforce_tracked_path_ownership\": ', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, '}') END",
    "governance/adopters.json": "CASE WHEN k % 10 = 0 THEN concat('{\"version\": 1, \"adopters\": [{\"id\": \"one\", \"repository\": \"O/One.git\", \"consumption\": {\"type\": \"pypi\"}}, {\"id\": \"', CASE WHEN k % 20 = 0 THEN 'one' ELSE 'two' END, '\", \"repository\": \"o/', CASE WHEN k % 30 = 0 THEN 'one' ELSE 'two' END, '\", \"consumption\": {\"type\": \"vendored\", \"files\": [{\"mode\": \"overlay\", \"overlay_path\": \"', CASE WHEN k % 40 = 0 THEN 'LICENSE' ELSE 'none.patch' END, '\", \"overlay_sha256\": \"00\"}]}}]}') END",
    "audits/registry.json": "CASE WHEN k % 29 = 0 THEN NULL ELSE concat('{\"scopes\": [', " + _SCOPE.format(path="'.'", contract="'AGENTS.md'", due="due") + ", CASE WHEN k % 12 = 0 THEN concat(', ', " + _SCOPE.format(path="'lib'", contract="'lib/AGENTS.md'", due="'soon'") + ") ELSE '' END, CASE WHEN k % 15 = 0 THEN concat(', ', " + _SCOPE.format(path="'gone'", contract="'gone/AGENTS.md'", due="'2000-09-01'") + ") ELSE '' END, ']}') END",
    "audits/findings/F1-x.json": "concat('{\"id\": \"', CASE WHEN k % 6 = 0 THEN 'X1' ELSE 'F1' END, '\", \"scope\": \"', CASE k % 5 WHEN 0 THEN 'zz' WHEN 1 THEN '' ELSE 'a' END, '\"}')",
    "audits/findings/G1-x.json": "CASE WHEN k % 16 = 0 THEN '3' ELSE concat('{\"id\": \"', CASE WHEN k % 8 = 0 THEN 'F1' ELSE 'G1' END, '\", \"scope\": \"a\"}') END",
    "decisions/0001-first.md": _FRONT.format(id="'0001'", title="CASE WHEN k % 9 = 0 THEN '' ELSE concat('Release ', v) END", status="CASE WHEN k % 7 = 0 THEN 'odd' ELSE 'accepted' END", more="date: ', CASE WHEN k % 10 = 0 THEN 'then' ELSE '2000-01-01' END, '\\nsupersedes: [', CASE WHEN k % 11 = 0 THEN '0009' ELSE '' END, ']\\nsource_of_truth: ', CASE WHEN k % 12 = 0 THEN 'gone/file.md' ELSE 'LICENSE' END, '\\n"),
    "decisions/0002-second.md": "CASE WHEN k % 13 = 0 THEN '# Bare\\n' ELSE " + _FRONT.format(id="CASE WHEN k % 14 = 0 THEN '0001' ELSE '0002' END", title="'Second'", status="'accepted'", more="date: 2000-01-02\\n") + " END",
    "governance/policies/001-basic.md": _FRONT.format(id="CASE WHEN k % 15 = 0 THEN '1' ELSE '001' END", title="'Basic'", status="'active'", more="', CASE WHEN k % 16 = 0 THEN '' ELSE 'applies_to: [all]\\n' END, '"),
    ".github/CODEOWNERS": "CASE WHEN k % 3 = 1 THEN '# all\\n* @team\\nsrc/* @team @dev # x\\nalone\\n' END",
    "CODEOWNERS": "'docs/* @writer\\n'",
    ".github/workflows/ci.yml": "CASE WHEN k % 4 = 0 THEN 'name: \"Build it\"\\non: push\\n' WHEN k % 4 = 1 THEN 'on: push\\n' END",
    "pyproject.toml": "CASE WHEN k % 2 = 0 THEN '[project]\\nversion = \"2.3.4\"\\n' END",
    "TODO.md": "concat('# Now\\n- [ ] Do **this**\\n- [x] Did `that`\\n## Later\\n- Some day ', k % 3, '\\n### Notes\\n- no item\\n')",
    "todos/TODO-007-fix-it.md": "CASE WHEN k % 2 = 0 THEN '# 7: Fix it\\nSee [it](../LICENSE).\\n' END",
    "todos/completed/old/README.md": "CASE WHEN k % 3 = 0 THEN '# Old\\n' END",
    "tracking/decisions.md": "CASE WHEN k % 4 = 0 THEN '## DEC-1: Use it\\nStatus: Accepted\\nDate: 1999-05-05\\n\\n## DEC-2: Or not\\nStatus: maybe\\n' END",
    "tracking/risks.md": "CASE WHEN k % 5 = 0 THEN '| RISK-1 | It breaks | P1 | open | watch | mend it |\\n| RISK-2 | It leaks | odd | closed |\\n' END",
    "tracking/milestones.md": "CASE WHEN k % 6 = 0 THEN '## M1: First\\nStatus: Shipped\\n\\n## M2\\nStatus: soon\\n' END",
}
_CTE = f"WITH base AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _BASE.items())} FROM supplier)"
_P = "SELECT repo_id, {path} AS path, {say} AS message, '{rule}' AS rule_id, {of} AS subject FROM {where}"


def fleet(table) -> DataFrame:
    """repo_id, path and content of all files."""
    base = spread(table("supplier").selectExpr(*(f"{e} AS {c}" for c, e in _BASE.items())), "k")
    each = F.array(*(F.struct(F.lit(path).alias("path"), F.expr(text).alias("text")) for path, text in FILES.items()))
    return base.select("repo_id", F.explode(each).alias("f")).where("f.text is not null").select("repo_id", "f.path", F.col("f.text").cast("binary").alias("content"))


def told(path: str, say: str, rule: str, where: str, of: str = "CAST(NULL AS VARCHAR)") -> str:
    """The SQL of one rule's rows: the file, what is said of it, and for which repositories."""
    return _P.format(path=f"'{path}'", say=say if "'" in say else f"'{say}'", rule=rule, where=f"base WHERE {where}", of=of)


def _query(*parts: str):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return f(_records(fleet(table), held=True), table)

        QUERIES[f.__name__] = run
        SQL[f.__name__] = _CTE + "\n" + "\nUNION ALL ".join(parts)
        return f

    return add


@_query(told("VERSION", "missing VERSION file", "P11", "k % 11 = 0"), told("VERSION", "'VERSION ''v1'' must be semantic (MAJOR.MINOR.PATCH)'", "P11", "k % 11 <> 0 AND k % 5 = 0"))
def rule_version(r: Records, table) -> DataFrame:
    return integrity.version(r, AS_OF)


_LABEL = "CASE k % 4 WHEN 1 THEN concat(v, '-rc.1') WHEN 2 THEN '9.9.9-rc.1' WHEN 3 THEN 'rc1' END"
_NOW = "CASE WHEN k % 11 = 0 THEN '' ELSE v END"


@_query(
    told("RELEASE_LABEL", f"'RELEASE_LABEL ''' || {_LABEL} || ''' must be a SemVer pre-release of VERSION (MAJOR.MINOR.PATCH-prerelease[+build], e.g. 2.3.0-rc.1)'", "P12", "k % 4 = 3 OR (k % 4 = 1 AND k % 5 = 0)"),
    told("RELEASE_LABEL", f"'RELEASE_LABEL base ''' || replace({_LABEL}, '-rc.1', '') || ''' must equal VERSION ''' || {_NOW} || ''''", "P12", "k % 4 = 2 OR (k % 4 = 1 AND k % 5 <> 0 AND k % 11 = 0)"),
)
def rule_release_label(r: Records, table) -> DataFrame:
    return integrity.release_label(r, AS_OF)


_TITLE = "CASE WHEN k % 9 = 0 THEN '' ELSE concat('Release ', v) END"


@_query(
    told("README.md", "'README advertises release ''0.0.1'' but VERSION is ''' || v || '''; update the release line together with VERSION'", "P13", "k % 11 <> 0 AND k % 3 = 2"),
    told("README.md", "'release changelog link escapes the repository: ../out.md'", "P13", "k % 11 <> 0 AND k % 3 <> 0 AND k % 7 = 2"),
    told("README.md", "'release changelog link does not resolve: gone.md'", "P13", "k % 11 <> 0 AND k % 3 <> 0 AND k % 7 = 3"),
    told("README.md", "'release changelog link ''decisions/0001-first.md'' documents '''', which does not name the current release ''' || v || ''''", "P13", "k % 11 <> 0 AND k % 3 <> 0 AND k % 7 = 4 AND k % 9 = 0"),
)
def rule_release_surface(r: Records, table) -> DataFrame:
    return integrity.release_surface(r, AS_OF)


@_query(
    told(".", "missing root AGENTS.md", "J9", "k % 13 = 0"), told("lib/AGENTS.md", "nested contract is not registered in audits/registry.json", "J9", "k % 6 = 0 AND (k % 12 <> 0 OR k % 29 = 0)"),
    *(told("lib/AGENTS.md", f"incomplete _audit companion, missing _audit/{f}", "J26", "k % 18 = 0") for f in ("inventory.md", "alignment-report.md")),
)
def rule_contracts(r: Records, table) -> DataFrame:
    return integrity.contracts(r, AS_OF)


@_query(
    told("governance/invariants.json", "no such file", "S1", "k % 17 = 0"), told("governance/invariants.json", "expected a JSON object", "S1", "k % 17 = 1"), told("governance/invariants.json", "'duplicate invariant id ''I1'''", "W1", "k % 17 > 1 AND k % 9 = 0", "'I1'"),
    told("governance/invariants.json", "invariant I1 is missing rationale", "P14", "k % 17 > 1 AND k % 5 = 0", "'I1'"), told("governance/invariants.json", "'invariant ' || CASE WHEN k % 9 = 0 THEN 'I1' ELSE 'I2' END || ' is missing escalation'", "P14", "k % 17 > 1", "CASE WHEN k % 9 = 0 THEN 'I1' ELSE 'I2' END"),
)
def rule_invariants(r: Records, table) -> DataFrame:
    return integrity.invariants(r, AS_OF)


@_query(told("governance/frozen-surface.json", "no such file", "S1", "k % 19 = 0"), told("governance/frozen-surface.json", "'protected entry ''src/*.py'' needs a reason'", "P15", "k % 19 <> 0 AND k % 4 = 0"))
def rule_frozen_surface(r: Records, table) -> DataFrame:
    return integrity.frozen_surface(r, AS_OF)


@_query(
    told("governance/adopters.json", "adopter ids must be unique", "A3", "k % 20 = 0"), told("governance/adopters.json", "adopter remote identities must be unique", "A3", "k % 30 = 0"),
    told("governance/adopters.json", "vendored overlay is unreadable: none.patch", "P24", "k % 10 = 0 AND k % 40 <> 0"), told("governance/adopters.json", "vendored overlay checksum drift: LICENSE", "P24", "k % 40 = 0"),
)
def rule_adopter_manifest(r: Records, table) -> DataFrame:
    return integrity.adopter_manifest(r, AS_OF)


_B = "CASE WHEN k % 7 = 0 THEN 'a' ELSE 'b' END"


@_query(
    told("governance/owners.json", "no such file", "S1", "k % 23 = 0"), told("governance/owners.json", "scope IDs must be unique", "A3", "k % 23 <> 0 AND k % 7 = 0"),
    told("governance/owners.json", f"'scope ''' || {_B} || ''' must declare non-empty path patterns'", "P16", "k % 23 <> 0 AND k % 8 = 0"), told("governance/owners.json", "'role ''keeper'' references unknown scope ''zz'''", "J7", "k % 23 <> 0 AND k % 3 = 0", "'keeper'"),
)
def rule_owners(r: Records, table) -> DataFrame:
    return integrity.owners(r, AS_OF)


def _tracked(r: Records) -> DataFrame:
    return r.repos.select("repo_id", F.explode(F.array(*map(F.lit, ("src/x.py", "src/y.py", "docs/a.md", "other\\b.txt")))).alias("path"))


_ASKS = "k % 23 <> 0 AND k % 2 = 0"


@_query(
    told("governance/owners.json", "'tracked path ''other/b.txt'' has no owner scope'", "J10", _ASKS, "'other/b.txt'"), told("governance/owners.json", "'tracked path ''docs/a.md'' has no owner scope'", "J10", f"{_ASKS} AND k % 8 = 0", "'docs/a.md'"),
    told("governance/owners.json", "'tracked path ''src/x.py'' has multiple owner scopes: a, b'", "J10", f"{_ASKS} AND k % 8 <> 0 AND k % 7 <> 0", "'src/x.py'"),
)
def rule_tracked_ownership(r: Records, table) -> DataFrame:
    return integrity.tracked_ownership(Records(r.tree, _tracked(r), keep=False), AS_OF)


@_query(
    told("audits/findings/G1-x.json", "expected a JSON object", "S1", "k % 16 = 0"), told("audits/findings/F1-x.json", "filename prefix must match finding id", "P6", "k % 6 = 0", "'X1'"), told("audits/findings/G1-x.json", "filename prefix must match finding id", "P6", "k % 8 = 0 AND k % 16 <> 0", "'F1'"),
    told("audits/findings/G1-x.json", "duplicate finding id also used by audits/findings/F1-x.json", "W1", "k % 8 = 0 AND k % 16 <> 0 AND k % 6 <> 0", "'F1'"), told("audits/findings/F1-x.json", "'unknown scope ''zz'''", "J6", "k % 5 = 0", "CASE WHEN k % 6 = 0 THEN 'X1' ELSE 'F1' END"),
    *(told(f"audits/findings/{f}-x.json", "'unknown scope ''a'''", "J6", f"k % 23 = 0 AND {w}", of) for f, w, of in (("F1", "k % 5 > 1", "CASE WHEN k % 6 = 0 THEN 'X1' ELSE 'F1' END"), ("G1", "k % 16 <> 0", "CASE WHEN k % 8 = 0 THEN 'F1' ELSE 'G1' END"))),
)
def rule_findings(r: Records, table) -> DataFrame:
    return integrity.findings(r, AS_OF)


_THERE = "k % 29 <> 0"


@_query(
    told("audits/registry.json", "no such file", "S1", "k % 29 = 0"), told("audits/registry.json", "audit scope does not exist: gone", "J17", f"{_THERE} AND k % 15 = 0", "'gone'"), told("audits/registry.json", "next_review must be an ISO date", "P7", f"{_THERE} AND k % 12 = 0", "'lib'"),
    told("audits/registry.json", "'audit scope ''.'' review deadline precedes its last review'", "P18", f"{_THERE} AND k % 4 = 1", "'.'"), told("audits/registry.json", "'audit scope ''.'' freshness expired on ' || due || '; re-review the scope and advance the registry dates'", "P18", f"{_THERE} AND k % 4 < 2", "'.'"),
)
def rule_audit_registry(r: Records, table) -> DataFrame:
    return integrity.audit_registry(r, AS_OF)


_STATES = "proposed, accepted, rejected, deferred, superseded, deprecated"


@_query(
    told("decisions/0002-second.md", "malformed front matter", "S5", "k % 13 = 0"), told("decisions/0001-first.md", "'front matter missing ''title'''", "P17", "k % 9 = 0", "'0001'"), told("decisions/0001-first.md", f"'status ''odd'' must be one of {_STATES}'", "P17", "k % 7 = 0", "'0001'"),
    told("decisions/0002-second.md", "filename prefix must match record id", "P6", "k % 14 = 0 AND k % 13 <> 0", "'0001'"), told("decisions/0002-second.md", "duplicate id also used by decisions/0001-first.md", "W1", "k % 14 = 0 AND k % 13 <> 0", "'0001'"),
    told("decisions/0001-first.md", "date must be an ISO date", "P7", "k % 10 = 0"), told("decisions/0001-first.md", "'supersedes unknown decision ''0009'''", "J8", "k % 11 = 0"),
)
def rule_decisions(r: Records, table) -> DataFrame:
    return integrity.decisions(r, AS_OF)


@_query(
    told("governance/policies/001-basic.md", "'front matter missing ''applies_to'''", "P17", "k % 16 = 0", "CASE WHEN k % 15 = 0 THEN '1' ELSE '001' END"), told("governance/policies/001-basic.md", "'id ''1'' must match [0-9]{3,}'", "P17", "k % 15 = 0", "'1'"),
    told("governance/policies/001-basic.md", "filename prefix must match record id", "P6", "k % 15 = 0", "'1'"),
)
def rule_policies(r: Records, table) -> DataFrame:
    return integrity.policies(r, AS_OF)


@_query(told("audits/reports/dashboard.md", "missing generated dashboard; generate it", "P19", "true"))
def rule_dashboard(r: Records, table) -> DataFrame:
    return integrity.dashboard(r, AS_OF)


_DASH = "chr(10)"


@_query(rf"""SELECT repo_id, '# Repository Dashboard' || n || n || '> Canonically generated from source records. Do not edit manually.' || n || '> Validation fails when this file differs from the generated text.' || n || '> Spec version: ' || CASE WHEN k % 11 = 0 THEN 'unknown' ELSE v END || n || n ||
 '## Health' || n || n || '| Metric | Count |' || n || '| --- | ---: |' || n || '| Invariants | 2 |' || n || '| Frozen-surface entries | 2 |' || n || '| Scope contracts | ' || (CASE WHEN k % 13 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END) || ' |' || n ||
 '| Audit registry entries | ' || (1 + CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 15 = 0 THEN 1 ELSE 0 END) || ' |' || n || '| Audit findings | 2 |' || n || '| Decision records | 2 |' || n || '| Policy records | 1 |' || n || '| Evidence runs | 0 |' || n || n ||
 '## Work' || n || n || '| Status | Count |' || n || '| --- | ---: |' || n || '| proposed | 0 |' || n || '| active | 0 |' || n || '| blocked | 0 |' || n || '| deferred | 0 |' || n || '| completed | 0 |' || n || n || '## Audit freshness' || n || n ||
 CASE WHEN k % 4 < 2 THEN '| Scope | Review was due |' || n || '| --- | --- |' || n || '| . | ' || due || ' |' ELSE 'All audit scopes are within their review cadence.' END || n || n || '## Active items' || n || n || 'No active or blocked work.' || n AS dashboard
FROM (SELECT *, chr(10) AS n FROM base) WHERE k % 17 > 1 AND k % 19 <> 0 AND k % 29 <> 0""")
def report_dashboard(r: Records, table) -> DataFrame:
    return report.dashboard(r, AS_OF)


@_query(*(f"SELECT repo_id, '{m}' AS metric, CAST({n} AS BIGINT) AS n FROM base" for m, n in (
    ("Invariants", "CASE WHEN k % 17 > 1 THEN 2 ELSE 0 END"), ("Frozen-surface entries", "CASE WHEN k % 19 = 0 THEN 0 ELSE 2 END"), ("Scope contracts", "CASE WHEN k % 13 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END"),
    ("Audit registry entries", "CASE WHEN k % 29 = 0 THEN 0 ELSE 1 + CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 15 = 0 THEN 1 ELSE 0 END END"), ("Audit findings", "2"), ("Decision records", "2"), ("Policy records", "1"), ("Evidence runs", "0"))))
def report_metrics(r: Records, table) -> DataFrame:
    return report.metrics(r)


@_query(f"SELECT repo_id, CAST(0 AS INTEGER) AS pos, '.' AS scope, due AS next_review FROM base WHERE {_THERE} AND k % 4 < 2")
def report_overdue(r: Records, table) -> DataFrame:
    return report.overdue(r, AS_OF)


@_query("SELECT repo_id, CASE WHEN k % 11 = 0 THEN 'unknown' ELSE v END AS version FROM base")
def report_shown_version(r: Records, table) -> DataFrame:
    return report.shown_version(r)


@_query("SELECT repo_id, '| ID | Statement | Enforced by |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| I1 | s | human review (escalation) |' || chr(10) || '| ' || CASE WHEN k % 9 = 0 THEN 'I1' ELSE 'I2' END || ' | t | x |' AS block FROM base WHERE k % 17 > 1")
def report_invariant_table(r: Records, table) -> DataFrame:
    return report.invariant_table(r)


def _doctor(severity: str, code: str, say: str, fixable: bool, where: str, of: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"SELECT repo_id, '{severity}' AS severity, '{code}' AS code, {say} AS message, {str(fixable).lower()} AS fixable, {of} AS subject FROM base WHERE {where}"


_FOUND = (
    _doctor("error", "registry-stale", "'registry scope ''gone'' points at a path/contract that does not exist'", True, f"{_THERE} AND k % 15 = 0", "'gone'"), _doctor("error", "registry-stale", "'registry scope ''.'' points at a path/contract that does not exist'", True, f"{_THERE} AND k % 13 = 0", "'.'"),
    _doctor("error", "no-root-contract", "'root AGENTS.md is missing (required contract)'", True, "k % 13 = 0"), _doctor("error", "contract-unregistered", "'nested contract lib/AGENTS.md is not registered in audits/registry.json'", True, "k % 6 = 0 AND (k % 12 <> 0 OR k % 29 = 0)", "'lib/AGENTS.md'"),
    *(_doctor("error", "audit-incomplete", f"'incomplete _audit companion: missing lib/_audit/{f}'", True, "k % 18 = 0", f"'lib/_audit/{f}'") for f in ("inventory.md", "alignment-report.md")),
    _doctor("warn", "source-of-truth-stale", "'decisions/0001-first.md: source_of_truth points at missing path ''gone/file.md'''", False, "k % 12 = 0", "'decisions/0001-first.md'"),
    _doctor("warn", "schema-missing", "'schema a.json is missing'", True, "true", "'a.json'"), _doctor("warn", "gitignored-record", "'governance record is git-ignored (missing on clone/CI): decisions/0001-first.md'", True, "k % 2 = 1", "'decisions/0001-first.md'"),
)


def _diagnosed(r: Records) -> DataFrame:
    shipped = r.tree.sparkSession.createDataFrame([("a.json", b"{}")], "name string, content binary")
    ignored = r.repos.where("cast(substring(repo_id, 2) as bigint) % 2 = 1").select("repo_id", F.explode(F.array(F.lit("decisions/0001-first.md"), F.lit("LICENSE"))).alias("path"))
    return doctor.diagnose(r, shipped, ignored)


@_query(*_FOUND)
def doctor_diagnose(r: Records, table) -> DataFrame:
    return _diagnosed(r)


@_query(f"""SELECT repo_id, CASE code WHEN 'registry-stale' THEN 'drop registry entry' WHEN 'no-root-contract' THEN 'add root contract' WHEN 'contract-unregistered' THEN 'register contract' WHEN 'audit-incomplete' THEN 'add audit stub' WHEN 'schema-missing' THEN 'add schema' ELSE 'negate ignore pattern' END AS action, subject FROM ({' UNION ALL '.join(_FOUND)}) WHERE fixable""",
    f"""SELECT repo_id, 'set preflight epoch', '{{"enabled":true,"required_from_date":"{AS_OF}"}}' FROM base WHERE k % 23 <> 0 AND k % 5 = 0""", "SELECT repo_id, 'generate dashboard', NULL FROM base")
def doctor_repairs(r: Records, table) -> DataFrame:
    return doctor.repairs(r, AS_OF, _diagnosed(r))


@_query("SELECT repo_id, '@team' AS handle, '*, src/*' AS globs FROM base WHERE k % 3 = 1", "SELECT repo_id, '@dev', 'src/*' FROM base WHERE k % 3 = 1", "SELECT repo_id, '@writer', 'docs/*' FROM base WHERE k % 3 <> 1")
def adoption_code_owners(r: Records, table) -> DataFrame:
    return adoption.code_owners(r).select("repo_id", "handle", F.array_join("globs", ", ").alias("globs"))


@_query("SELECT repo_id, '.github/workflows/ci.yml' AS path, CASE WHEN k % 4 = 0 THEN 'Build it' ELSE 'ci' END AS title FROM base WHERE k % 4 < 2")
def adoption_workflows(r: Records, table) -> DataFrame:
    return adoption.workflows(r)


@_query("SELECT repo_id, CASE WHEN k % 11 <> 0 AND k % 5 <> 0 THEN v WHEN k % 2 = 0 THEN '2.3.4' ELSE '0.1.0' END AS version FROM base")
def adoption_version(r: Records, table) -> DataFrame:
    return adoption.detected_version(r)


@_query("SELECT repo_id, path, CASE path WHEN 'VERSION' THEN CASE WHEN k % 11 = 0 THEN 'create' ELSE 'skip' END WHEN 'AGENTS.md' THEN CASE WHEN k % 13 = 0 THEN 'create' ELSE 'skip' END WHEN 'governance/owners.json' THEN CASE WHEN k % 23 = 0 THEN 'create' ELSE 'skip' END WHEN 'governance/invariants.json' THEN CASE WHEN k % 17 = 0 THEN 'create' ELSE 'skip' END WHEN 'governance/frozen-surface.json' THEN CASE WHEN k % 19 = 0 THEN 'create' ELSE 'skip' END ELSE CASE WHEN k % 29 = 0 THEN 'create' ELSE 'skip' END END AS action FROM base, (SELECT unnest(['VERSION', 'AGENTS.md', 'governance/owners.json', 'governance/invariants.json', 'governance/frozen-surface.json', 'audits/registry.json']) AS path)")
def adoption_bootstrap(r: Records, table) -> DataFrame:
    return adoption.missing_files(adoption.bootstrap(r.repos, AS_OF), r).select("repo_id", "path", "action")


def _changed(r: Records) -> DataFrame:
    one, two = (r.repos.select("repo_id", F.explode(F.array(*map(F.lit, own))).alias("path")) for own in (("src/a.py", "docs/b/c.md"), ("docs/b/c.md", "src/a.txt", "docs2/x")))
    return change.changed_paths([one, two])


@_query("SELECT repo_id, 'src/a.py' AS hit, CASE WHEN k % 4 = 0 THEN ' ' ELSE 'core' END AS reason FROM base WHERE k % 19 <> 0", "SELECT repo_id, 'docs/b/c.md', 'told' FROM base WHERE k % 19 <> 0")
def change_paths(r: Records, table) -> DataFrame:
    return change.path_hits(r, _changed(r)).withColumnRenamed("path", "hit")


@_query("SELECT repo_id, 'keep_me' AS hit, CASE WHEN k % 4 = 0 THEN ' ' ELSE 'core' END AS reason FROM base WHERE k % 19 <> 0 AND k % 2 = 0")
def change_symbols(r: Records, table) -> DataFrame:
    even = F.col("repo_id").substr(2, 20).cast("bigint") % 2 == 0
    patch = r.repos.select("repo_id", F.lit("p").alias("path"), F.when(even, F.lit("+++ keep_me\n+def keep_me():\n-keep_me\n")).otherwise(F.lit("--- keep_me\n+keep_me_not\n keep_me\n")).alias("text"))
    return change.symbol_hits(r, patch).withColumnRenamed("symbol", "hit")


_PLANS = (
    "SELECT repo_id, 'active' AS lifecycle, 'fix-it' AS slug, 'Fix it' AS title, 'todos/TODO-007-fix-it.md' AS source, '007' AS num, 1 AS place FROM base WHERE k % 2 = 0",
    "SELECT repo_id, 'completed', 'old', 'Old', 'todos/completed/old', NULL, 2 FROM base WHERE k % 3 = 0",
    "SELECT repo_id, 'active', 'do-this', 'Do this', 'TODO.md', NULL, 3 FROM base", "SELECT repo_id, 'completed', 'did-that', 'Did that', 'TODO.md', NULL, 4 FROM base", "SELECT repo_id, 'deferred', concat('some-day-', k % 3), concat('Some day ', k % 3), 'TODO.md', NULL, 5 FROM base",
)


@_query(f"SELECT repo_id, lifecycle, slug, title, source, num FROM ({' UNION ALL '.join(_PLANS)})")
def planning_discover(r: Records, table) -> DataFrame:
    return planning.discover(r).select("repo_id", "lifecycle", "slug", "title", "source", "num")


@_query(f"""SELECT repo_id, slug, status, CASE status WHEN 'completed' THEN 'waived' ELSE 'pending' END AS criterion_state, item_id, concat('work/', status, '/', item_id, '-', slug) AS home
FROM (SELECT repo_id, slug, lifecycle AS status, coalesce(num, concat('', 199 + row_number() OVER (PARTITION BY repo_id, num IS NULL ORDER BY place))) AS item_id FROM ({' UNION ALL '.join(_PLANS)}))""")
def planning_planned(r: Records, table) -> DataFrame:
    return planning.planned(r).select("repo_id", "slug", "status", "criterion_state", "item_id", "home")


@_query("SELECT repo_id, '# 7: Fix it' || chr(10) || 'See [it](../../../LICENSE).' || chr(10) AS narrative FROM base WHERE k % 2 = 0")
def planning_rebased(r: Records, table) -> DataFrame:
    return planning.rebased(planning.planned(r).where("num is not null")).select("repo_id", "narrative")


@_query("SELECT repo_id, '0003' AS decision_id, 'Use it' AS title, 'accepted' AS status, '1999-05-05' AS date, 'decisions/0003-use-it.md' AS path FROM base WHERE k % 4 = 0", f"SELECT repo_id, '0004', 'Or not', 'accepted', '{AS_OF}', 'decisions/0004-or-not.md' FROM base WHERE k % 4 = 0")
def planning_decisions(r: Records, table) -> DataFrame:
    return planning.tracked_decisions(r, AS_OF).select("repo_id", "decision_id", "title", "status", "date", "path")


@_query("SELECT repo_id, '001' AS finding_id, '[RISK-1] It breaks' AS observed, 'high' AS risk, 'open' AS state, 'mend it' AS reconciliation, 'tracking/risks.md#RISK-1' AS source FROM base WHERE k % 5 = 0", "SELECT repo_id, '002', '[RISK-2] It leaks', 'medium', 'reconciled', 'See source risk register.', 'tracking/risks.md#RISK-2' FROM base WHERE k % 5 = 0")
def planning_risks(r: Records, table) -> DataFrame:
    return planning.tracked_risks(r, AS_OF).select("repo_id", "finding_id", "observed", "risk", "state", "reconciliation", "source")


@_query("SELECT repo_id, '300' AS item_id, 'milestone-first' AS slug, 'M1: First' AS title, 'completed' AS status, 'waived' AS criterion_state FROM base WHERE k % 6 = 0", "SELECT repo_id, '301', 'milestone-status-soon', 'M2: Status: soon', 'active', 'pending' FROM base WHERE k % 6 = 0")
def planning_milestones(r: Records, table) -> DataFrame:
    """A heading without a title takes the next line for it, as the format has it."""
    return planning.tracked_milestones(r).select("repo_id", "item_id", "slug", "title", "status", "criterion_state")


@_query("SELECT repo_id, 'todos' AS folder, 'block' AS action, concat(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END, ' unmigrated items') AS reason FROM base WHERE k % 2 = 0 OR k % 3 = 0")
def planning_retirement(r: Records, table) -> DataFrame:
    git = r.repos.select("repo_id", F.lit("todos").alias("folder"), F.lit(True).alias("tracked"), F.lit(True).alias("clean"), F.lit("h").alias("head"))
    return planning.retirement(r, git)
