"""Rules over many schemas, patterns, folders and numbers that are rendered from the driver's tables, and the same rows in DuckDB's SQL.

Parts are repositories with schemas of their own, or bring the patterns of owners; orders are changed and tracked paths.
Each query goes by rendered files; its SQL goes by the columns alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import text as t
from recordloom.operators import history
from recordloom.operators import relational as ops
from recordloom.plans import adoption, change, integrity, planning, report
from recordloom.sources.records import Records
from recordloom.sources.snapshot import overlay, overlay_refs, with_contents, with_folders
from recordloom.sources.stored import written

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)
        SQL[f.__name__] = sql
        return f

    return add


def _json(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


#: A schema and a finding for each part, by expressions that both engines read; `k` tells all schemas apart.
_K = "p_partkey"
_STARTS = f"concat('^', CASE WHEN {_K} % 3 = 0 THEN substr(p_name, 1, 2) ELSE 'r' END)"
_SCHEMA = _json(
    """'{"type": "object", "required": ["id", "risk"], "additionalProperties": false, "properties": {"risk": {}, "price": {}, "id": {"type": "string", "pattern": "'""", _STARTS, """'"}, "size": {"type": "integer", "minimum": '""", f"{_K} % 30",
    """', "maximum": 40}, "brand": {"enum": ["Brand#1", "Brand#'""", f"{_K} % 25", """'"], "not": {"const": "Brand#1"}}, "kind": '""", f"""CASE WHEN {_K} % 5 = 0 THEN '{{"const": "ECONOMY"}}' ELSE 'true' END""",
    """', "tags": {"$ref": "#/$defs/tags"}, "either": {"oneOf": [{"type": "string"}, {"type": "integer", "minimum": '""", _K,
    """'}, {"type": "number", "maximum": 50}]}}, "if": {"properties": {"kind": {"const": "ECONOMY"}}, "required": ["kind"]}, "then": {"required": ["price"]}, "else": {"required": ["other"]}, "$defs": {"tags": {"type": "array", "minItems": 2, "items": {"type": "string", "minLength": '""", f"{_K} % 10", """'}}}}'""",
)
_FINDING = _json(
    """'{"id": "'""", "p_name", """'", "size": '""", f"""CASE WHEN {_K} % 7 = 0 THEN concat('"', p_size, '"') ELSE concat('', p_size) END""", """', "brand": "'""", "p_brand", """'", "kind": "'""", "p_type", """'", "tags": '""",
    f"""CASE WHEN {_K} % 3 = 0 THEN concat('["', p_name, '"]') ELSE concat('["', p_brand, '", "', p_name, '"]') END""", """', "either": '""", f"""CASE {_K} % 4 WHEN 0 THEN concat('', {_K}) WHEN 1 THEN concat('', {_K} - 1) WHEN 2 THEN '"text"' ELSE 'null' END""",
    f"""CASE WHEN {_K} % 11 = 0 THEN '' ELSE ', "risk": "low"' END""", f"""CASE WHEN {_K} % 2 = 0 THEN ', "price": 1.5' ELSE '' END""", f"""CASE WHEN {_K} % 6 = 1 THEN ', "other": 1' ELSE '' END""", "'}'",
)
_FOUND = (
    ("<root>", "'''risk'' is a required property'", "k % 11 = 0"), ("<root>", "'Additional properties are not allowed (''other'' was unexpected)'", "k % 6 = 1"),
    ("id", "'''' || p_name || ''' does not match ''' || starts || ''''", "NOT starts_with(p_name, substr(starts, 2))"),
    ("size", "'''' || p_size || ''' is not of type ''integer'''", "k % 7 = 0"), ("size", "p_size || ' is less than the minimum of ' || (k % 30)", "k % 7 <> 0 AND p_size < k % 30"), ("size", "p_size || ' is greater than the maximum of 40'", "k % 7 <> 0 AND p_size > 40"),
    ("brand", "'''' || p_brand || ''' is not one of [''Brand#1'', ''Brand#' || (k % 25) || ''']'", "p_brand NOT IN ('Brand#1', 'Brand#' || (k % 25))"), ("brand", "'''Brand#1'' should not be valid under {''const'': ''Brand#1''}'", "p_brand = 'Brand#1'"),
    ("kind", "'''ECONOMY'' was expected'", "k % 5 = 0 AND p_type <> 'ECONOMY'"),
    ("tags", "'[''' || p_name || '''] is too short'", "k % 3 = 0"), ("tags/0", "'''' || p_name || ''' is too short'", "k % 3 = 0 AND length(p_name) < k % 10"), ("tags/0", "'''' || p_brand || ''' is too short'", "k % 3 <> 0 AND length(p_brand) < k % 10"), ("tags/1", "'''' || p_name || ''' is too short'", "k % 3 <> 0 AND length(p_name) < k % 10"),
    ("either", "k || ' is valid under each of {''type'': ''number'', ''maximum'': 50}, {''type'': ''integer'', ''minimum'': ' || k || '}'", "k % 4 = 0 AND k <= 50"),
    ("either", "CASE k % 4 WHEN 1 THEN '' || (k - 1) ELSE 'None' END || ' is not valid under any of the given schemas'", "(k % 4 = 1 AND k - 1 > 50) OR k % 4 = 3"),
    ("<root>", "'''price'' is a required property'", "p_type = 'ECONOMY' AND k % 2 <> 0"), ("<root>", "'''other'' is a required property'", "p_type <> 'ECONOMY' AND k % 6 <> 1"),
)


@_query(f"WITH base AS (SELECT *, p_partkey AS k, {_STARTS} AS starts FROM part)\n" + "\nUNION ALL ".join(f"SELECT 'q' || k AS repo_id, 'audits/findings/1-a.json' AS path, 'schema {at}: ' || {say} AS message FROM base WHERE {where}" for at, say, where in _FOUND))
def rule_schema_messages(table, spark: SparkSession) -> DataFrame:
    """Each part's finding by the schema of its own repository: as many schemas as parts."""
    part = table("part").select(F.concat(F.lit("q"), "p_partkey").alias("repo_id"), F.expr(_SCHEMA).alias("schema"), F.expr(_FINDING).alias("finding"))
    files = F.array(*(F.struct(F.lit(path).alias("path"), F.col(c).cast("binary").alias("content")) for path, c in (("schemas/audit-finding.schema.json", "schema"), ("audits/findings/1-a.json", "finding"))))
    r = Records(with_folders(part.select("repo_id", F.explode(files).alias("f")).select("repo_id", "f.*")), keep=False)
    return integrity.schemas(r, {"findings": {}}).select("repo_id", "path", "message")


#: Paths of orders, and a glob of each part, for the same four repositories.
_PATH = "concat('area', o_custkey % 50, '/', lower(substr(o_orderpriority, 3, 4)), '/m', o_orderkey % 97, '/f', o_orderkey, CASE o_orderstatus WHEN 'F' THEN '.py' WHEN 'O' THEN '.md' ELSE '.test.ts' END)"
_GLOB = f"""CASE {_K} % 7 WHEN 0 THEN concat('area', {_K} % 50, '/high/m', {_K} % 97, '/**') WHEN 1 THEN concat('area', {_K} % 50, '/*/m', {_K} % 97, '/*.py') WHEN 2 THEN concat('area', {_K} % 50, '/urge/m', {_K} % 97, '/f[0-4]*.md')
  WHEN 3 THEN concat('*/m', {_K} % 97, '/f', {_K}, '.*') WHEN 4 THEN concat('area', {_K} % 50, '/low/m?', '/f', {_K} % 10, '*') WHEN 5 THEN concat('*/f', {_K}, '.test.ts') ELSE concat('area', {_K} % 50, '/medi/m', {_K} % 97, '/f', {_K}, '.md') END"""
_GLOBS = f"p AS (SELECT concat('r', o_orderkey % 4) AS repo_id, {_PATH} AS path FROM orders), g AS (SELECT concat('r', {_K} % 4) AS repo_id, concat('s', {_K} % 300) AS id, {_K} AS k, {_GLOB} AS glob FROM part)"


def _paths(table) -> DataFrame:
    return table("orders").selectExpr("concat('r', o_orderkey % 4) AS repo_id", f"{_PATH} AS path")


@_query(f"""WITH {_GLOBS}, h AS (SELECT DISTINCT repo_id, path, id FROM p LEFT JOIN g ON p.repo_id = g.repo_id AND p.path GLOB g.glob)
SELECT repo_id, path, count(id) AS n_owners, coalesce(string_agg(id, ', ' ORDER BY id), '') AS owners FROM h GROUP BY repo_id, path""".replace("SELECT DISTINCT repo_id, path, id", "SELECT DISTINCT p.repo_id, path, id"))
def pattern_ownership(table, spark: SparkSession) -> DataFrame:
    """Owners of the paths of orders by the globs of parts: a path meets the patterns on its own way through the index."""
    globs = table("part").selectExpr(f"concat('r', {_K} % 4) AS repo_id", f"concat('s', {_K} % 300) AS id", f"{_GLOB} AS glob")
    out = ops.owners(_paths(table), globs, "path", ["repo_id"])
    return out.select("repo_id", "path", F.size("owners").cast("bigint").alias("n_owners"), F.array_join("owners", ", ").alias("owners"))


@_query(f"""WITH {_GLOBS} SELECT p.repo_id, path, 'why ' || k AS reason FROM (SELECT DISTINCT * FROM p) p JOIN g ON p.repo_id = g.repo_id AND (p.path GLOB g.glob OR p.path GLOB (rtrim(g.glob, '/*') || '/*'))""")
def change_protected(table, spark: SparkSession) -> DataFrame:
    """Changed paths, those of orders, under the protected globs of parts; each repository's frozen surface is one file."""
    each = F.struct(F.col("k"), F.col("glob"), F.concat(F.lit("why "), "k").alias("reason"))
    surface = table("part").selectExpr(f"concat('r', {_K} % 4) AS repo_id", f"{_K} AS k", f"{_GLOB} AS glob").groupBy("repo_id").agg(F.array_sort(F.collect_list(each)).alias("protected"))
    files = surface.select("repo_id", F.lit("governance/frozen-surface.json").alias("path"), F.to_json(F.struct(F.lit(1).alias("version"), "protected")).cast("binary").alias("content"))
    return change.path_hits(Records(with_folders(files), keep=False), change.changed_paths([_paths(table)]))


#: Lines of files that name retired folders, one for each part, and what lies below them, named like the suppliers' work items.
_TOKEN = "concat(CASE WHEN l_linenumber % 2 = 0 THEN '../' ELSE '' END, 'plan', l_partkey, '/', l_suppkey, '-w', CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '/README.md' ELSE '/gone.md' END)"
_LINED = f"""SELECT concat('r', l_orderkey % 4) AS repo_id, concat('docs/l', l_orderkey % 200, '.md') AS path, l_partkey AS part, l_suppkey AS supp, l_linenumber AS nth, l_quantity % 2 = 0 AS linked, {_TOKEN} AS token,
  row_number() OVER (PARTITION BY l_orderkey % 4, l_orderkey % 200 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS pos FROM lineitem"""


@_query(f"""WITH l AS ({_LINED}), own AS (SELECT l.*, s_suppkey IS NOT NULL AS home, CASE WHEN nth % 2 = 0 THEN '../' ELSE '' END || 'work/active/' || supp || '-w' AS dir
  FROM l JOIN part ON p_partkey = part AND concat('r', p_partkey % 4) = repo_id LEFT JOIN supplier ON s_suppkey = supp AND concat('r', s_suppkey % 4) = repo_id)
SELECT repo_id, path, CAST(pos AS INTEGER) AS pos, token, CASE WHEN home THEN dir || CASE WHEN nth % 3 = 0 THEN '' ELSE '/README.md' END END AS mapped, CASE WHEN linked THEN 'link' ELSE 'mention' END AS kind FROM own""")
def reference_tokens(table, spark: SparkSession) -> DataFrame:
    """Mentions of as many retired folders as there are parts, in one pass over the lines of lineitem, and what they map to."""
    lines = spark.sql(_LINED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table("lineitem"))
    said = F.when(F.col("linked"), F.concat(F.lit("See [it]("), "token", F.lit("), please."))).otherwise(F.concat(F.lit("As "), "token", F.lit(" tells.")))
    docs = lines.groupBy("repo_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))), lambda x: x["said"]), "\n").alias("text"))
    folder = F.concat(F.lit("work/active/"), "s_suppkey", F.lit("-w"))
    work = table("supplier").select(F.concat(F.lit("r"), F.col("s_suppkey") % 4).alias("repo_id"), F.explode(F.array(F.struct(F.concat(folder, F.lit("/work-item.json")).alias("path"), F.lit('{"id": "001"}').alias("text")), F.struct(F.concat(folder, F.lit("/README.md")).alias("path"), F.lit("# Work").alias("text")))).alias("f")).select("repo_id", "f.*")
    r = Records(with_folders(docs.unionByName(work).select("repo_id", "path", F.col("text").cast("binary").alias("content"))), keep=False)
    retired = table("part").select(F.concat(F.lit("r"), F.col("p_partkey") % 4).alias("repo_id"), F.concat(F.lit("plan"), "p_partkey").alias("folder"))
    return planning.references(r, retired).select("repo_id", "path", "pos", "token", "mapped", "kind")


#: Commits of orders in five repositories: a trunk, branches that are merged or left alone, and merges across them.
_HISTORY = """WITH RECURSIVE c AS (SELECT repo_id, n, concat('c', o_orderkey) AS id, author, CAST((n - n % 10) / 10 AS INT) AS decade FROM (SELECT *, concat('r', o_custkey % 5) AS repo_id, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS n, concat('a', o_custkey) AS author FROM orders)),
e AS (SELECT a.repo_id, a.id AS child, b.id AS parent FROM c a JOIN c b ON a.repo_id = b.repo_id AND (b.n = a.n - CASE a.n % 10 WHEN 5 THEN 4 WHEN 7 THEN 3 ELSE 1 END OR (a.n % 10 = 0 AND a.decade % 5 <> 3 AND b.n = a.n - 4) OR (a.n % 10 = 8 AND a.decade % 7 = 2 AND b.n = a.n - 3))),
top AS (SELECT repo_id, arg_max(id, n) AS id FROM c GROUP BY repo_id),
side AS (SELECT repo_id, arg_max(id, n) AS id FROM c WHERE n % 10 = 6 AND decade % 5 = 2 GROUP BY repo_id),
tag AS (SELECT repo_id, id, 'v' || id AS tag FROM c WHERE CAST(substr(id, 2) AS INT) % 97 = 0),
h AS (SELECT repo_id, 'top' AS label, id FROM top UNION ALL SELECT repo_id, 'side', id FROM side UNION ALL SELECT repo_id, tag, id FROM tag),
reach AS (SELECT repo_id, label, id FROM h UNION SELECT r.repo_id, r.label, e.parent FROM reach r JOIN e ON e.repo_id = r.repo_id AND e.child = r.id),
own AS (SELECT repo_id, id FROM reach WHERE label = 'top')
"""


def _history(table) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commits of orders, and the heads top (the last commit) and side (the last one of a branch that was not merged)."""
    w = Window.partitionBy(F.col("o_custkey") % 5).orderBy("o_orderkey")
    own = table("orders").select(F.concat(F.lit("r"), F.col("o_custkey") % 5).alias("repo_id"), F.row_number().over(w).alias("n"), F.concat(F.lit("c"), "o_orderkey").alias("id"), F.concat(F.lit("a"), "o_custkey").alias("author"), "o_custkey", "o_orderkey")
    own = own.withColumn("decade", F.expr("(n - n % 10) div 10"))
    back = {k: F.lag("id", k).over(w) for k in (1, 3, 4)}
    before = F.when(F.col("n") % 10 == 5, back[4]).when(F.col("n") % 10 == 7, back[3]).otherwise(back[1])
    merged = F.when((F.col("n") % 10 == 0) & (F.col("decade") % 5 != 3), back[4]).when((F.col("n") % 10 == 8) & (F.col("decade") % 7 == 2), back[3])
    # The log stays in its order, as one comes from version control.
    commits = own.select("repo_id", "id", "author", F.array_compact(F.array(before, merged)).alias("parents"), "n", "decade")
    commits = written(commits, "commits")
    top = commits.groupBy("repo_id").agg(F.max_by("id", "n").alias("id"))
    return commits, top, commits.where("n % 10 = 6 AND decade % 5 = 2").groupBy("repo_id").agg(F.max_by("id", "n").alias("id"))


@_query(_HISTORY + """, depth AS (SELECT t.repo_id, t.tag, count(*) AS n FROM tag t JOIN own o ON o.repo_id = t.repo_id AND o.id = t.id JOIN reach r ON r.repo_id = t.repo_id AND r.label = t.tag GROUP BY ALL),
last AS (SELECT repo_id, arg_max(tag, (n, tag)) AS latest_tag FROM depth GROUP BY repo_id)
SELECT top.repo_id, count(*) AS commits, substr(any_value(top.id), 1, 7) AS head, any_value(latest_tag) AS latest_tag, count(DISTINCT author) AS contributors
FROM top JOIN own USING (repo_id) JOIN c ON c.repo_id = own.repo_id AND c.id = own.id LEFT JOIN last ON last.repo_id = top.repo_id GROUP BY top.repo_id""")
def repository_statistics(table, spark: SparkSession) -> DataFrame:
    """Commits, head, latest tag and contributors of repositories whose commits are the orders."""
    commits, top, _ = _history(table)
    tags = commits.where(F.substring("id", 2, 20).cast("bigint") % 97 == 0).select("repo_id", F.concat(F.lit("v"), "id").alias("tag"), "id")
    return history.statistics(commits, top, tags)


@_query(_HISTORY + """, common AS (SELECT a.repo_id, a.id FROM own a SEMI JOIN (SELECT * FROM reach WHERE label = 'side') b ON b.repo_id = a.repo_id AND b.id = a.id)
SELECT repo_id, id FROM common WHERE NOT EXISTS (SELECT 1 FROM e JOIN common y ON y.repo_id = e.repo_id AND y.id = e.child WHERE e.repo_id = common.repo_id AND e.parent = common.id)""")
def history_merge_bases(table, spark: SparkSession) -> DataFrame:
    """Where a branch left the trunk."""
    commits, top, side = _history(table)
    heads = top.select("repo_id", F.lit("top").alias("label"), "id").unionByName(side.select("repo_id", F.lit("side").alias("label"), "id"))
    return history.merge_bases(commits, history.reachable(commits, heads), "top", "side")


_TITLE = "CASE WHEN o_orderkey % 5 = 0 THEN ' ' WHEN o_orderkey % 7 = 0 THEN '!' ELSE o_orderpriority END"


@_query(f"""WITH i AS (SELECT concat('r', o_custkey % 8) AS repo_id, o_orderkey AS number, {_TITLE} AS title, o_orderstatus = 'F' AS closed, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey DESC) AS n FROM orders),
named AS (SELECT repo_id, number, closed, CASE WHEN trim(title) = '' THEN 'issue-' || number ELSE title END AS title FROM i WHERE n <= 200)
SELECT repo_id, 'github:#' || number AS source, title, CASE WHEN closed THEN 'completed' ELSE 'active' END AS lifecycle, coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'issue') AS slug FROM named""")
def planning_issues(table, spark: SparkSession) -> DataFrame:
    """Orders as issues, the 200 newest of each repository."""
    issues = table("orders").selectExpr("concat('r', o_custkey % 8) AS repo_id", "o_orderkey AS number", f"{_TITLE} AS title", "'' AS body", "CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'OPEN' END AS state", "'' AS url")
    return planning.from_issues(issues).select("repo_id", "source", "title", "lifecycle", "slug")


@_query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'About ' || p_name || chr(10) || '<!-- generated:x -->' || chr(10) || p_type || chr(10) || '<!-- /generated:x -->' || chr(10) || 'end' END AS text FROM part""")
def report_blocks(table, spark: SparkSession) -> DataFrame:
    """A generated block of each part's text is made anew; a text without its markers has none."""
    mark = F.when(F.col("p_partkey") % 4 == 0, "other").otherwise("x")
    text = F.concat(F.lit("About "), "p_name", F.lit("\n<!-- generated:"), mark, F.lit(" -->\nold "), "p_brand", F.lit("\nlines\n<!-- /generated:"), mark, F.lit(" -->\nend"))
    return table("part").select(F.col("p_partkey").alias("k"), report.replace_block(text, "x", F.col("p_type")).alias("text"))


@_query("""SELECT concat('r', o_custkey % 100) AS repo_id, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderstatus = 'F') AS work_items, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderstatus = 'O') AS decisions,
count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderstatus = 'P') AS findings, count(*) FILTER (o_orderkey % 3 = 0) AS skipped FROM orders GROUP BY ALL""")
def adoption_counts(table, spark: SparkSession) -> DataFrame:
    """What an import of orders would create, by the kinds of their paths, and skip."""
    path = "CASE o_orderstatus WHEN 'F' THEN concat('work/active/', o_orderkey, '-x/work-item.json') WHEN 'O' THEN concat('decisions/', o_orderkey, '.md') ELSE concat('audits/findings/', o_orderkey, '.json') END AS path"
    return adoption.report_counts(table("orders").selectExpr("concat('r', o_custkey % 100) AS repo_id", path, "CASE WHEN o_orderkey % 3 = 0 THEN 'skip' ELSE 'create' END AS action"))


@_query("""WITH v AS (SELECT concat('r', p_partkey % 40) AS repo_id, unnest([CASE p_partkey % 3 WHEN 0 THEN 'todos' WHEN 1 THEN 'plans/' || p_brand ELSE 'todosx/' || p_brand END, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'plans/' || p_type || '/AGENTS.md' END]) AS value FROM part)
SELECT DISTINCT repo_id, folder, value FROM v, (SELECT unnest(['todos', 'plans']) AS folder) WHERE value = folder OR starts_with(value, folder || '/')""")
def planning_scopes_inside(table, spark: SparkSession) -> DataFrame:
    """Audit scopes and contracts, parts in the registries of forty repositories, that lie in two folders of plans."""
    entry = F.struct(F.expr("CASE p_partkey % 3 WHEN 0 THEN 'todos' WHEN 1 THEN concat('plans\\\\', p_brand) ELSE concat('todosx/', p_brand) END").alias("path"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('plans/', p_type, '/AGENTS.md') END").alias("contract"))
    own = table("part").select(F.concat(F.lit("r"), F.col("p_partkey") % 40).alias("repo_id"), entry.alias("e")).groupBy("repo_id").agg(F.to_json(F.struct(F.collect_list("e").alias("scopes"))).cast("binary").alias("content"))
    r = Records(with_folders(own.select("repo_id", F.lit("audits/registry.json").alias("path"), "content")), keep=False)
    return planning.scopes_inside(r, r.repos.select("repo_id", F.explode(F.array(F.lit("todos"), F.lit("plans"))).alias("folder"))).select("repo_id", "folder", "value")


@_query("""SELECT p_partkey AS k, '{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || ',"zero":null}' AS json, p_name || chr(10) || p_brand || chr(13) || chr(10) AS unix FROM part""")
def deterministic_texts(table, spark: SparkSession) -> DataFrame:
    """Parts as JSON with sorted keys, and texts whose ends of lines are made plain."""
    json_ = report.as_json({"zero": F.lit(None).cast("string"), "name": F.col("p_name"), "size": F.col("p_size"), "brand": F.col("p_brand")})
    unix = t.unix_ends(F.concat("p_name", F.lit("\r\n"), "p_brand", F.lit("\r\r\n")).cast("binary")).cast("string")
    return table("part").select(F.col("p_partkey").alias("k"), json_.alias("json"), unix.alias("unix"))


#: A base of files for each nation, and what each customer's case has in their place or besides: contents of its own, and
#: some that many cases share.
_CASE = {"nation": ("concat('nations/', c_nationkey, '.json')", "c_name", "c_custkey % 3 = 0"), "segment": ("concat('own/', c_mktsegment, '.md')", "c_mktsegment", "c_custkey % 5 = 0")}
_OWN = " UNION ALL ".join(f"SELECT c_custkey AS k, {path} AS path, {text} AS text FROM customer WHERE {where}" for path, text, where in _CASE.values())


def _cases(customer: DataFrame, files: dict[str, tuple[str, str, str]]) -> DataFrame:
    """repo_id, path and content of the cases' own files; path, text and condition of each kind."""
    own = F.array(*(F.when(F.expr(where), F.struct(F.expr(path).alias("path"), F.expr(text).cast("binary").alias("content"))) for path, text, where in files.values()))
    return customer.select(F.concat(F.lit("c"), "c_custkey").alias("repo_id"), F.explode(own).alias("f")).where("f IS NOT NULL").select("repo_id", "f.*")


@_query(f"""
WITH own AS ({_OWN}), base AS (SELECT 'nations/' || n_nationkey || '.json' AS path, n_name AS text FROM nation),
files AS (SELECT * FROM own UNION ALL SELECT c_custkey, path, text FROM customer, base WHERE NOT (c_custkey % 3 = 0 AND path = 'nations/' || c_nationkey || '.json'))
SELECT 'c' || k AS repo_id, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, sha256(string_agg(path || ':' || sha256(text), chr(10) ORDER BY path)) AS tree_sha256 FROM files GROUP BY k
""")
def conformance_overlays(table, spark: SparkSession) -> DataFrame:
    """Each customer's case over one base of nations: its files, bytes of contents, and a digest of its tree."""
    base = table("nation").select(F.concat(F.lit("nations/"), "n_nationkey", F.lit(".json")).alias("path"), F.col("n_name").cast("binary").alias("content"))
    over = _cases(table("customer"), _CASE | {"meta": ("'meta.json'", "c_name", "true")})
    files = with_contents(*overlay_refs(base, over))
    line = F.concat("path", F.lit(":"), F.sha2("content", 256))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"])
    return files.groupBy("repo_id").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("content")).alias("n_bytes"), F.sha2(F.array_join(lines, "\n"), 256).alias("tree_sha256"))


_MUST = "must be semantic"
_CHECKED = {
    "meta": ("'meta.json'", f"""concat('{{"expect": "', CASE WHEN c_custkey % 4 < 2 THEN 'reject' ELSE 'accept' END, '", "fragment": "', CASE WHEN c_custkey % 8 = 1 THEN 'missing' ELSE '{_MUST}' END, '"}}')""", "true"),
    "version": ("'VERSION'", "CASE WHEN c_custkey % 4 = 2 THEN '2.0.1' ELSE concat('v', c_nationkey) END", "c_custkey % 4 <> 3 OR c_custkey % 3 = 0"),
}


@_query("SELECT 'c' || c_custkey AS \"case\", CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN c_custkey % 8 <> 1 WHEN 2 THEN true ELSE c_custkey % 3 <> 0 END AS passed, CAST(c_custkey % 4 < 2 OR (c_custkey % 4 = 3 AND c_custkey % 3 = 0) AS BIGINT) AS n_problems FROM customer")
def conformance_verdicts(table, spark: SparkSession) -> DataFrame:
    """Each customer's case, judged by the rule of versions, against what its manifest expects."""
    over = _cases(table("customer"), _CHECKED)
    region, content = table("region"), lambda x: x.cast("binary").alias("content")
    base = region.select(F.concat(F.lit("regions/"), "r_regionkey", F.lit(".md")).alias("path"), content(F.col("r_name"))).unionByName(region.select(F.lit("VERSION").alias("path"), content(F.lit("1.0.0"))).distinct())
    expected = over.where("path = 'meta.json'").select("repo_id", F.from_json(F.decode("content", "UTF-8"), "expect string, fragment string").alias("m")).select("repo_id", "m.*")
    r = Records(with_folders(overlay(base, over)), keep=False)
    return integrity.verdicts(expected, r, integrity.version(r, "2026-07-26"))
