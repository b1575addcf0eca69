"""Fleets, releases, research facts and schemas over the driver's nations and suppliers, and the same rows in DuckDB's SQL.

Regions are upstream repositories and nations their adopters; suppliers are repositories with research metadata.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as t
from recordloom.plans import fleet, integrity, planning, research
from recordloom.plans.record_queries import _records
from recordloom.sources.records import Records
from recordloom.sources.stored import spread

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
AS_OF = "2000-06-01"
_SHA = {x: hashlib.sha256(x.encode()).hexdigest() for x in ("AA", "AB")}
#: Columns of an adopter, read by both engines.
_ADOPTERS = {
    "k": "n_nationkey", "repo_id": "concat('g', n_regionkey)", "id": "concat('a', n_nationkey)", "repository": "concat('org/n', n_nationkey, '.git')", "key": "concat('org/n', n_nationkey)",
    "vendors": "n_nationkey % 3 = 0", "head": "CASE WHEN n_nationkey % 7 <> 0 THEN concat('h', n_nationkey) END", "upstream_version": "CASE WHEN n_nationkey % 4 = 0 THEN '1.2.0' ELSE '1.1.0' END",
    "marker": "CASE WHEN n_nationkey % 5 = 4 THEN NULL WHEN n_nationkey % 3 = 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN '1.2.0' ELSE 'x' END WHEN n_nationkey % 11 = 1 THEN 'tool==1.2.0, tool==1.1.0' WHEN n_nationkey % 4 = 1 THEN 'tool==1.1.0' ELSE 'tool==1.2.0' END",
    "mine": "CASE WHEN n_nationkey % 6 = 3 THEN 'AB' ELSE 'AA' END",
}
_CTE = f"WITH a AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _ADOPTERS.items())} FROM nation), base AS (SELECT s_suppkey AS k, concat('m', s_suppkey) AS repo_id FROM supplier)"


def _query(*parts: str, of: Callable):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return f(_records(of(table), held=True), table)

        QUERIES[f.__name__] = run
        SQL[f.__name__] = _CTE + "\n" + "\nUNION ALL ".join(parts)
        return f

    return add


def _files(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out.select("repo_id", "path", F.col("text").cast("binary").alias("content"))


def _nations(table) -> DataFrame:
    return table("nation").selectExpr(*(f"{e} AS {c}" for c, e in _ADOPTERS.items()))


def upstream(table) -> DataFrame:
    """repo_id, path and content of the regions' repositories: their releases and manifests of adopters."""
    lit = F.lit
    own = F.struct(lit("exact").alias("mode"), lit("a.txt").alias("upstream_path"), lit("b.txt").alias("adopter_path"), lit(_SHA["AA"]).alias("upstream_sha256"), lit(_SHA["AA"]).alias("adopter_sha256"))
    use = F.struct(
        F.when(F.col("vendors"), "vendored").otherwise("pypi").alias("type"), F.when(F.col("vendors"), "V").otherwise("req.txt").alias("version_file"), F.when(F.col("vendors"), F.col("upstream_version")).alias("upstream_version"),
        F.when(F.col("vendors"), "u").alias("upstream_revision"), F.when(F.col("vendors"), F.array(own)).alias("files"),
    )
    adopter = F.struct("id", "repository", lit("main").alias("default_branch"), use.alias("consumption"))
    each = _nations(table).groupBy("repo_id").agg(F.sort_array(F.collect_list(adopter)).alias("adopters"))  # a region has few nations
    manifest = F.to_json(F.struct(lit(1).alias("version"), F.struct(lit("org/up").alias("repository"), lit("tool").alias("package")).alias("upstream"), "adopters"))
    return _files(each.select("repo_id", lit("governance/adopters.json").alias("path"), manifest.alias("text")), each.select("repo_id", lit("VERSION").alias("path"), lit("1.2.0\n").alias("text")))


def _remotes(table) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Branch heads, files and local clones, as tables."""
    n = _nations(table)
    heads = n.where("head is not null").select("repository", F.lit("main").alias("branch"), "head")
    file = lambda path, text: F.struct(path.alias("path"), text.alias("text"))
    marker = F.when(F.col("vendors"), F.col("marker")).otherwise(F.replace("marker", F.lit(", "), F.lit("\n")))
    files = n.select("repository", F.col("head").alias("revision"), F.explode(F.array(file(F.when(F.col("vendors"), "V").otherwise("req.txt"), F.concat(marker, F.lit("\n"))), file(F.lit("b.txt"), F.col("mine")))).alias("f"))
    files = files.where("f.text is not null").select("repository", "revision", "f.path", "f.text")
    ups = n.limit(1).select(F.lit("org/up").alias("repository"), F.lit("u").alias("revision"), F.lit("a.txt").alias("path"), F.lit("AA").alias("text"))
    url = F.when(F.col("k") % 2 == 0, F.concat(F.lit("https://host.org/"), "repository")).otherwise(F.concat(F.lit("git@host.org:"), "repository"))
    clones = n.select(url.alias("url"), F.concat(F.lit("/c/"), "k").alias("path"), (F.col("k") % 3 == 0).alias("marked")).unionByName(n.where("k < 4").select(F.concat(F.lit("ssh://git@host.org/other/z"), F.col("k") % 2).alias("url"), F.concat(F.lit("/z/"), "k").alias("path"), (F.col("k") % 2 == 0).alias("marked")))
    return heads, files.unionByName(ups).select("repository", "revision", "path", F.col("text").cast("binary").alias("content")), clones


_HAS = "head IS NOT NULL AND marker IS NOT NULL"
_PINS = "NOT vendors AND k % 11 <> 1"
_TOLD = "CASE WHEN vendors THEN marker WHEN k % 11 <> 1 THEN substr(marker, 7) END"
_ERRORS = f"""list_sort(list_filter([CASE WHEN head IS NULL THEN 'branch can''t be resolved: main' END, CASE WHEN head IS NOT NULL AND marker IS NULL THEN 'version file is missing: ' || CASE WHEN vendors THEN 'V' ELSE 'req.txt' END END,
  CASE WHEN {_HAS} AND NOT vendors AND k % 11 = 1 THEN 'version file must contain one exact tool==X.Y.Z pin' END, CASE WHEN {_HAS} AND vendors AND marker = 'x' THEN 'vendored version marker must contain one semantic version' END,
  CASE WHEN {_HAS} AND vendors AND upstream_version <> '1.2.0' THEN 'vendored upstream_version 1.1.0 does not match current release 1.2.0' END, CASE WHEN {_HAS} AND {_TOLD} <> '1.2.0' THEN 'declared version ' || {_TOLD} || ' is stale; current release is 1.2.0' END,
  CASE WHEN {_HAS} AND vendors AND mine = 'AB' THEN 'b.txt: adopter checksum drift ({_SHA["AB"]})' END, CASE WHEN {_HAS} AND vendors AND mine = 'AB' THEN 'b.txt: declared exact copy differs from upstream' END], lambda x: x IS NOT NULL))"""
_CHECKS = f"""list_sort(list_filter([CASE WHEN head IS NOT NULL THEN 'public branch resolved: ' || head END, CASE WHEN {_HAS} AND {_PINS} THEN 'exact pin: tool==' || {_TOLD} END, CASE WHEN {_HAS} AND vendors AND mine = 'AA' THEN 'exact checksum parity: b.txt' END], lambda x: x IS NOT NULL))"""
_VERIFIED = f"SELECT repo_id, id, key, CASE WHEN head IS NULL THEN NULL ELSE {_TOLD} END AS declared, {_CHECKS} AS checks, {_ERRORS} AS errors, k FROM a"


def _verified(r: Records, table) -> DataFrame:
    return fleet.verify(r, *_remotes(table))


@_query(f"SELECT repo_id, id, declared, concat('/c/', k) AS clones, array_to_string(checks, '; ') AS checks, array_to_string(errors, '; ') AS errors, len(errors) = 0 AS ok FROM ({_VERIFIED})", of=upstream)
def fleet_verify(r: Records, table) -> DataFrame:
    return _verified(r, table).select("repo_id", "id", "declared", F.array_join("local_checkouts", "; ").alias("clones"), F.array_join("checks", "; ").alias("checks"), F.array_join("errors", "; ").alias("errors"), "ok")


@_query(f"SELECT repo_id, count(*) AS n, bool_and(len(errors) = 0) AS ok FROM ({_VERIFIED}) GROUP BY repo_id", of=upstream)
def fleet_sound(r: Records, table) -> DataFrame:
    return fleet.fleet_ok(_verified(r, table))


@_query("SELECT 'other/z0' AS key, '/z/0, /z/2' AS paths, true AS marked", of=upstream)
def fleet_unregistered(r: Records, table) -> DataFrame:
    return fleet.unregistered(r, _remotes(table)[2]).select("key", F.array_join("paths", ", ").alias("paths"), "marked")


@_query(f"""SELECT g.repo_id, array_to_string(list_filter([CASE WHEN r = 0 THEN 'package evidence is missing' END, CASE WHEN r = 1 THEN 'package evidence did not pass' END, CASE WHEN r = 2 THEN 'package evidence is of another release' END, CASE WHEN r = 3 THEN 'package evidence lacks the published artifact' END,
  CASE WHEN NOT ok THEN 'fleet verification failed' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM (SELECT repo_id, CAST(substr(repo_id, 2) AS INTEGER) AS r, bool_and(len(errors) = 0) AS ok FROM ({_VERIFIED}) GROUP BY ALL) g""", of=upstream)
def fleet_closeout(r: Records, table) -> DataFrame:
    n = F.substring("repo_id", 2, 9).cast("int")
    package = r.repos.where(n > 0).select("repo_id", F.when(n == 1, "failed").otherwise("passed").alias("result"), F.when(n == 2, "1.1.0").otherwise("1.2.0").alias("release"), F.lit("https://p.org/t/").alias("url"), F.when(n == 3, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("https://p.org/t"))).alias("artifacts"))
    return fleet.closeout(r, _verified(r, table), package).select("repo_id", F.array_join("errors", "; ").alias("errors"))


@_query(
    "SELECT concat('x', k) AS repo_id, concat('x', k) AS path, 'archive has 2 top-level packages' AS message, 'P29' AS rule_id, CAST(NULL AS VARCHAR) AS subject FROM a WHERE k % 3 = 0",
    "SELECT concat('x', k), concat('x', k), 'expected 2 members below tool/s/, found 1', 'P29', NULL FROM a WHERE k % 2 = 0", "SELECT concat('x', k), concat('x', k), 'flat modules: tool.py', 'P29', NULL FROM a WHERE k % 3 = 0", of=upstream,
)
def fleet_archives(r: Records, table) -> DataFrame:
    members = F.array_compact(F.array(F.lit("tool/a.py"), F.lit("tool/s/1.json"), F.when(F.col("k") % 2 == 1, F.lit("tool/s/2.json")), F.when(F.col("k") % 3 == 0, F.lit("tool.py")), F.lit("tool-1.dist-info/RECORD")))
    return fleet.archive_problems(_nations(table).select(F.concat(F.lit("x"), "k").alias("archive"), F.explode(members).alias("member")), {"tool/s/": 2}, ("tool.py",))


#: Texts of a research repository by path, from its number.
_RESEARCH = {
    "research/metadata.json": """CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN '3' ELSE concat('{"version": 1, "claim_freshness": {"policy": "', CASE WHEN k % 4 = 0 THEN 'none.md' ELSE 'POLICY.md' END, '", "last_reviewed": "2000-05-10", "next_review": "', CASE k % 5 WHEN 2 THEN '2000-05-20' WHEN 3 THEN '2000-05-01' WHEN 4 THEN '2000-09-01' ELSE '2000-06-05' END,
 '", "documents": ["research/paper.md", "research/protocol.md"', CASE WHEN k % 6 = 0 THEN ', "research/paper.md"' ELSE '' END, CASE WHEN k % 7 = 0 THEN ', "research/lost.md"' ELSE '' END, ']}, "lifecycle": {"states": ["proposed", "active", "blocked", "deferred", ', CASE WHEN k % 8 = 0 THEN '"done"' ELSE '"completed"' END, '], "set_documents": [{"path": "research/paper.md", "pattern": "states: (.*)"}], "figure_documents": [{"path": "research/protocol.md", "section": "Figure"}]},
 "benchmark": {"task_count": 24, "documents": [{"path": "research/paper.md", "pattern": "([0-9]+) tasks"}], "study_hypotheses": {"S1": "H1", "S2": "H2"}, "range_documents": [{"path": "research/paper.md", "pattern": "H([0-9]+) to H([0-9]+)"}], "mapping_documents": ["research/protocol.md"]},
 "threats": {"ids": ["T1", "T2"], "pattern": "(T[0-9]+):", "documents": ["research/protocol.md"]}, "proposed_state_trace": [{"path": "POLICY.md", "tokens": ["alpha", "beta"]}, {"path": "', CASE WHEN k % 9 = 0 THEN 'gone.md' ELSE 'POLICY.md' END, '", "tokens": []}]}') END""",
    "research/paper.md": "concat('states: `proposed`, `active`, `blocked`, `deferred`, ', CASE WHEN k % 11 = 0 THEN '`lost`' ELSE '`completed`' END, '\\n', CASE k % 12 WHEN 0 THEN 'no count' WHEN 1 THEN '23 tasks' ELSE '24 tasks' END, ' H1 to H', CASE WHEN k % 13 = 0 THEN '3' ELSE '2' END, '\\n')",
    "research/protocol.md": "concat('## Figure\\n```\\nproposed active blocked deferred ', CASE WHEN k % 14 = 0 THEN '' ELSE 'completed' END, '\\n```\\n## Studies\\n### S1 a → H1\\n### S2 b → ', CASE WHEN k % 15 = 0 THEN 'H9' ELSE 'H2' END, '\\n## Threats\\nT1: x\\n', CASE k % 16 WHEN 0 THEN '' WHEN 1 THEN 'T2: y\\nT2: again\\n' WHEN 2 THEN 'T2: y\\nT7: new\\n' ELSE 'T2: y\\n' END)",
    "POLICY.md": "CASE WHEN k % 17 = 0 THEN 'alpha' ELSE 'alpha beta' END",
    "schemas/audit-finding.schema.json": """CASE WHEN k % 3 = 0 THEN '{"type": "object", "required": ["id", "risk"], "properties": {"id": {"type": "string", "pattern": "^F"}}}' END""",
    "audits/findings/F1-a.json": """CASE WHEN k % 2 = 0 THEN '{"id": "F1", "scope": 3}' ELSE '{"id": "G1", "risk": "low"}' END""",
    "todos/007-old/README.md": "'# Old\\n'",
    "work/active/007-old/work-item.json": """'{"id": "007", "title": "Old", "source": "todos/007-old"}'""",
    "work/active/007-old/README.md": "'# Old\\n'",
    "docs/guide.md": "concat('See [it](../todos/007-old/README.md) and [more](../todos/none/x.md).\\nAs todos/007-old tells.\\nsource_of_truth: todos/007-old/', CASE WHEN k % 2 = 0 THEN 'plan.md' ELSE 'README.md' END, '\\nThe todos/007-old/ folder.\\n')",
}


def papers(table) -> DataFrame:
    base = spread(table("supplier").selectExpr("s_suppkey AS k", "concat('m', s_suppkey) AS repo_id"), "k")
    each = F.array(*(F.struct(F.lit(path).alias("path"), F.expr(text).alias("text")) for path, text in _RESEARCH.items()))
    return _files(base.select("repo_id", F.explode(each).alias("f")).where("f.text is not null").select("repo_id", "f.path", "f.text"))


def _says(path: str, say: str, rule: str, where: str) -> str:
    return f"SELECT repo_id, '{path}' AS path, '{say}' AS message, '{rule}' AS rule_id, CAST(NULL AS VARCHAR) AS subject FROM base WHERE {where}"


_M, _OK = "research/metadata.json", "k % 10 > 1"
_SAME = f"{_OK} AND k % 8 <> 0"


@_query(
    _says(_M, "missing research metadata", "P33", "k % 10 = 0"), _says(_M, "expected a JSON object", "S28", "k % 10 = 1"),
    _says(_M, "claim review deadline precedes its last review", "P20", f"{_OK} AND k % 5 = 3"), _says(_M, "claim review cadence exceeds 30 days", "P20", f"{_OK} AND k % 5 = 4"),
    _says(_M, "research claims expired on 2000-05-20", "P20", f"{_OK} AND k % 5 = 2"), _says(_M, "research claims expired on 2000-05-01", "P20", f"{_OK} AND k % 5 = 3"), _says(_M, "claim documents must be unique", "A3", f"{_OK} AND k % 6 = 0"),
    _says(_M, "claim freshness policy does not exist: none.md", "P20", f"{_OK} AND k % 4 = 0"), _says(_M, "declared claim document does not exist: research/lost.md", "J23", f"{_OK} AND k % 7 = 0"),
    _says(_M, "canonical lifecycle states must be: proposed, active, blocked, deferred, completed", "P21", f"{_OK} AND k % 8 = 0"),
    _says("research/paper.md", "lifecycle states contradict metadata: expected proposed, active, blocked, deferred, completed; observed proposed, active, blocked, deferred, lost", "P21", f"{_SAME} AND k % 11 = 0"),
    _says("research/protocol.md", "lifecycle figure contradicts metadata; missing state(s): completed", "P21", f"{_SAME} AND k % 14 = 0"),
    _says("research/paper.md", "task-count fact is missing", "P22", f"{_OK} AND k % 12 = 0"), _says("research/paper.md", "task count contradicts metadata: expected 24; observed 23", "P22", f"{_OK} AND k % 12 = 1"),
    _says("research/paper.md", "benchmark hypothesis range contradicts metadata: expected H1–H2; observed H1–H3", "P22", f"{_OK} AND k % 13 = 0"),
    _says("research/protocol.md", 'study-to-hypothesis mapping contradicts metadata: expected [{"key":"S1","value":"H1"},{"key":"S2","value":"H2"}]; observed [{"key":"S1","value":"H1"},{"key":"S2","value":"H9"}]', "J31", f"{_OK} AND k % 15 = 0"),
    _says("research/protocol.md", "threat is missing: T2", "J24", f"{_OK} AND k % 16 = 0"), _says("research/protocol.md", "threat is repeated: T2", "J24", f"{_OK} AND k % 16 = 1"), _says("research/protocol.md", "unexpected threat: T7", "J24", f"{_OK} AND k % 16 = 2"),
    _says(_M, "trace target does not exist: gone.md", "P23", f"{_OK} AND k % 9 = 0"), _says(_M, "trace target POLICY.md lacks: beta", "P23", f"{_OK} AND k % 17 = 0"), of=papers,
)
def rule_research(r: Records, table) -> DataFrame:
    return research.facts(r, AS_OF)


@_query("SELECT repo_id, path, count(*) AS n FROM (SELECT repo_id, 'audits/findings/F1-a.json' AS path FROM base WHERE k % 3 = 0 AND k % 2 = 0 UNION ALL SELECT repo_id, 'audits/findings/F1-a.json' FROM base WHERE k % 3 = 0 AND k % 2 = 1 UNION ALL SELECT repo_id, 'audits/findings/F1-a.json' FROM base WHERE k % 3 <> 0 AND k % 2 = 0) GROUP BY ALL", of=papers)
def rule_schemas(r: Records, table) -> DataFrame:
    """How many problems a schema finds: a repository's own one goes before the given one, which asks for a text as scope."""
    given = {"findings": {"type": "object", "properties": {"scope": {"type": "string"}}}}
    return integrity.schemas(r, given).groupBy("repo_id", "path").agg(F.count("*").alias("n"))


_REFS = (
    ("1", "'../todos/007-old/README.md'", "'../work/active/007-old/README.md'", "link"), ("1", "'../todos/none/x.md'", "NULL", "link"), ("2", "'todos/007-old'", "'work/active/007-old'", "mention"), ("3", "CASE WHEN k % 2 = 0 THEN 'todos/007-old/plan.md' ELSE 'todos/007-old/README.md' END", "'work/active/007-old/README.md'", "pointer"), ("4", "'todos/007-old/'", "'work/active/007-old/'", "mention"),
)


@_query(*(f"SELECT repo_id, 'docs/guide.md' AS path, CAST({pos} AS INTEGER) AS pos, {token} AS token, {to} AS mapped, '{kind}' AS kind FROM base" for pos, token, to, kind in _REFS), "SELECT repo_id, 'work/active/007-old/work-item.json', 1, 'todos/007-old', 'work/active/007-old', 'mention' FROM base", of=papers)
def planning_references(r: Records, table) -> DataFrame:
    return planning.references(r, r.repos.select("repo_id", F.lit("todos").alias("folder"))).select("repo_id", "path", "pos", "token", "mapped", "kind")


@_query("SELECT repo_id, 'todos' AS folder, 'todos/007-old' AS source, true AS migrated FROM base", of=papers)
def planning_migrated(r: Records, table) -> DataFrame:
    return planning.migrated(r)


@_query("SELECT repo_id, 'todos' AS folder, CASE k % 4 WHEN 0 THEN 'delete' ELSE 'archive' END AS action, CASE k % 4 WHEN 1 THEN 'not tracked' WHEN 2 THEN 'uncommitted or ignored files' WHEN 3 THEN 'no commit' END AS reason FROM base", of=papers)
def planning_recoverable(r: Records, table) -> DataFrame:
    n = F.substring("repo_id", 2, 9).cast("int") % 4
    return planning.retirement(r, r.repos.select("repo_id", F.lit("todos").alias("folder"), (n != 1).alias("tracked"), (n != 2).alias("clean"), F.when(n != 3, "h").alias("head")))


#: Functions of text on columns of the driver's tables.
_TEXTS = """SELECT p_partkey AS k, trim(regexp_replace(concat(p_partkey, ': ', p_name), '^\\s*\\d+\\s*[—–:-]\\s+', '')) AS title, lpad(concat('', p_partkey), 3, '0') AS number, regexp_replace(p_name, '[^a-z0-9]+', '-', 'g') AS slug,
 concat('a/', p_size, '/c') AS path, concat('owner', p_partkey, '/repo') AS remote, regexp_replace(concat(p_brand, '/**'), '[/*]+$', '') AS stripped, replace(p_name, ' ', '%20') AS encoded, CASE WHEN p_partkey % 3 = 0 THEN 'completed' WHEN p_partkey % 3 = 1 THEN 'deferred' END AS section FROM part"""


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    number, slug = t.split_number(F.concat(F.lit("TODO-"), F.lpad(F.col("p_partkey").cast("string"), 3, "0"), F.lit("-"), "p_name"))
    url = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://host/owner"), "p_partkey", F.lit("/repo.git"))).otherwise(F.concat(F.lit("git@host:owner"), "p_partkey", F.lit("/repo")))
    heading = F.when(F.col("p_partkey") % 3 == 0, "Released now").when(F.col("p_partkey") % 3 == 1, "Some future").otherwise("Notes")
    return part.select(
        F.col("p_partkey").alias("k"), t.clean_title(F.concat("p_partkey", F.lit(": "), "p_name")).alias("title"), number.alias("number"), slug.alias("slug"), t.normal_path(F.concat(F.lit("./a/b/../"), "p_size", F.lit("//c"))).alias("path"), t.canonical_remote(url).alias("remote"),
        t.rstrip_chars(F.concat("p_brand", F.lit("/**")), "/*").alias("stripped"), t.url_path("p_name").alias("encoded"), t.section_lifecycle(heading).alias("section"),
    )


QUERIES["text_functions"], SQL["text_functions"] = text_functions, _TEXTS
