"""The record rules over a fleet of record trees that is rendered from the driver's tables, and the same rows in DuckDB's SQL.

Orders are work items, lines their criteria, suppliers evidence runs. The columns that the records are made of are given as
expressions that both engines read; from there the rules go by files, JSON and Markdown, and the SQL by the columns alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.plans import adoption, doctor, integrity, report
from recordloom.sources.records import Records

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
AS_OF = "2000-06-01"
SCOPES = ("s1", "s2", "s3", "s4")
_DAY = "CAST(CAST({} AS DATE) AS VARCHAR(10))"
_BLOCK = "CAST(({0} - {0} % 64) / 64 AS INT) % 8"

#: Work items of orders, in steps: a step may use the columns of those before.
ITEMS = (
    {
        "k": "o_orderkey",
        "repo_id": f"CASE WHEN o_orderkey % 251 < 2 THEN 'r8' ELSE concat('r', {_BLOCK.format('o_orderkey')}) END",
        "id": "CASE WHEN o_orderkey % 13 = 0 THEN concat('', o_orderkey % 90) WHEN o_orderkey % 17 = 0 THEN concat('', o_orderkey % 400 + 100) ELSE lpad(concat('', o_orderkey), 6, '0') END",
        "folder": "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'blocked' WHEN o_orderkey % 3 = 0 THEN 'proposed' ELSE 'active' END",
        "whole": "o_orderkey % 23 <> 0",
        "noted": "o_orderkey % 29 <> 0",
        "ready": "o_orderkey % 43 <> 0",
        "level": "CASE WHEN o_orderkey % 7 = 0 THEN 'provisional' WHEN o_orderkey % 7 = 1 THEN 'concrete' END",
        "owner": "concat('s', substr(o_orderpriority, 1, 1))",
        "other": "concat('s', o_custkey % 6)",
        "created": f"CASE WHEN o_orderkey % 41 = 0 THEN '1995/01/02' ELSE {_DAY.format('o_orderdate')} END",
        "before": "CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN lpad(concat('', o_orderkey - 1), 6, '0') WHEN (o_orderkey + 1) % 74 = 0 THEN lpad(concat('', o_orderkey + 1), 6, '0') END",
        "odd": "CASE WHEN o_orderkey % 31 = 0 THEN 'nope' END",
    },
    {
        "status": "CASE WHEN k % 59 = 0 THEN 'paused' ELSE folder END",
        "place": "CASE folder WHEN 'proposed' THEN 1 WHEN 'active' THEN 2 WHEN 'blocked' THEN 3 ELSE 5 END",
        "itself": "CASE WHEN k % 37 = 0 THEN id END",
        "parent": "concat('work/', folder, '/', CASE WHEN k % 19 = 0 THEN 'x' ELSE id END, '-o', k)",
    },
    {"path": "concat(parent, '/work-item.json')"},
)
#: Criteria of lines; `nth` tells lines of one order apart.
LINES = (
    {
        "k": "l_orderkey",
        "nth": "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)",
        "cid": "CASE WHEN l_partkey % 53 = 0 THEN '' ELSE concat('AC-', l_linenumber) END",
        "state": "CASE WHEN l_returnflag = 'R' THEN 'waived' WHEN l_linestatus = 'F' THEN 'satisfied' ELSE 'pending' END",
        "run": "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat('ev-', l_suppkey) END",
        "level": "CASE WHEN l_partkey % 5 = 0 THEN 'provisional' END",
        "mark": "CASE WHEN (l_linestatus = 'F' AND l_returnflag <> 'R') = (l_partkey % 7 <> 0) THEN 'x' ELSE ' ' END",
        "boxed": "l_linenumber <= 3 AND l_partkey % 53 <> 0 AND l_orderkey % 5 <> 0",
    },
)
#: Evidence runs of suppliers.
RUNS = (
    {
        "k": "s_suppkey",
        "repo_id": "concat('r', s_suppkey % 8)",
        "id": "CASE WHEN s_suppkey % 7 = 0 THEN concat('ev-', s_suppkey - 7) ELSE concat('ev-', s_suppkey) END",
        "whole": "s_suppkey % 11 <> 0",
        "stamp": "CASE WHEN s_suppkey % 5 = 0 THEN 'yesterday' ELSE '2000-01-02T10:00:00+00:00' END",
        "item": "lpad(concat('', s_suppkey), 6, '0')",
        "level": "CASE WHEN s_suppkey % 4 = 0 THEN 'provisional' WHEN s_suppkey % 4 = 1 THEN 'concrete' END",
        "path": "concat('evidence/runs/ev-', s_suppkey, '.json')",
    },
)
#: Folders of customers that hold planning without a manifest.
STRAYS = ({"repo_id": "concat('r', c_custkey % 8)", "path": "concat('work/', CASE WHEN c_custkey % 2 = 0 THEN 'active/' ELSE '' END, 'stray-', c_custkey)", "shown": "c_custkey % 50 = 0"},)
_SOURCES = (("items", "orders", ITEMS), ("lines", "lineitem", LINES), ("runs", "supplier", RUNS), ("strays", "customer", STRAYS))
#: In r9 a manifest can't be read, so none of its work is known.
_BROKEN = {"work/active/001-a/work-item.json": "[1]", "work/active/002-b/work-item.json": '{"id": "002"}', "governance/owners.json": "{}"}


def _columns(table, name: str, steps, raw: tuple[str, ...] = ()) -> DataFrame:
    """The columns of all steps, and raw ones of the table."""
    df = table(name)
    for k, step in enumerate(steps):
        df = df.selectExpr(*(["*"] if k else raw), *(f"{e} AS {c}" for c, e in step.items()))
    return df


def _ctes(*names: str) -> str:
    out = []
    for name, source, steps in _SOURCES:
        if name in names:
            inner = source
            for k, step in enumerate(steps):
                inner = f"(SELECT {'*, ' * bool(k)}{', '.join(f'{e} AS {c}' for c, e in step.items())} FROM {inner})"
            out.append(f"{name} AS {inner}")
    return "WITH " + ",\n".join(out)


def fleet(table) -> DataFrame:
    """repo_id, top, path and content of all files of the fleet; what isn't asked for isn't rendered."""
    items, lines, runs, strays = (_columns(table, source, steps, ("l_orderkey",) if source == "lineitem" else ()) for _, source, steps in _SOURCES)
    listed = lambda *own: F.array_compact(F.array(*own))
    text = F.lit
    each = F.struct("nth", F.struct(F.col("cid").alias("id"), text("x").alias("text"), "state", listed("run").alias("evidence"), F.col("level").alias("provenance")).alias("c"), F.when(F.col("boxed"), F.concat(text("- ["), "mark", text("] **"), "cid", text("** done"))).alias("box"))
    # The lines of an order are few. By the column that they are numbered by they aren't shuffled again.
    of = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(each)).alias("own"))
    items = items.join(of, "k", "left").withColumn("own", F.coalesce("own", F.array().cast(of.schema["own"].dataType)))
    mark = F.when(F.col("ready"), F.struct(text(True).alias("created_before_work_started")))
    record = F.struct(
        "id", F.when(F.col("whole"), text("An order")).alias("title"), "status", F.col("owner").alias("owner_scope"), listed("other").alias("affected_scopes"), listed("before", "itself", "odd").alias("depends_on"),
        F.transform("own", lambda x: x["c"]).alias("acceptance_criteria"), "created", F.when(F.col("whole"), F.col("created")).alias("updated"), F.col("level").alias("provenance"), mark.alias("preflight"),
    )
    boxes = F.array_join(F.filter(F.transform("own", lambda x: x["box"]), lambda x: x.isNotNull()), "\n")
    run = F.struct("id", F.col("stamp").alias("timestamp"), F.col("item").alias("work_item"), F.when(F.col("whole"), text("passed")).alias("result"), F.col("level").alias("provenance"), F.array().cast("array<string>").alias("commands"), F.array().cast("array<string>").alias("artifacts"), F.create_map(text("os"), text("any")).alias("environment"))
    owners = lambda apart: json.dumps({"scopes": [{"id": s, "paths": [f"{s}/**"], "owner": "team"} for s in SCOPES], "roles": [{"id": "keeper", "scopes": ["s1", "s9"]}], "concurrency": {"enforce_disjoint_active_scopes": apart}, "preflight": {"enabled": True, "required_from_date": "1995-06-01"}})
    # Both files of an item come of one row, so its lines are gathered once; the text is made behind a filter of paths.
    both = items.select("*", F.explode(listed(text("m"), F.when(F.col("noted"), text("n")))).alias("kind"))
    mine = lambda manifest, note: F.when(F.col("kind") == "m", manifest).otherwise(note)
    spark = items.sparkSession
    broken = spark.createDataFrame([("r9", p, x) for p, x in _BROKEN.items()], "repo_id string, path string, text string")
    files = [
        both.select("repo_id", text("work").alias("top"), mine(F.col("path"), F.concat("parent", text("/README.md"))).alias("path"), mine(F.to_json(record), F.concat(text("# Order\n\n"), boxes, text("\n"))).alias("text")),
        runs.select("repo_id", text("evidence").alias("top"), "path", F.to_json(run).alias("text")), strays.where("shown").select("repo_id", text("work").alias("top"), F.concat("path", text("/README.md")).alias("path"), text("# Stray\n").alias("text")),
        spark.range(9).select(F.concat(text("r"), "id").alias("repo_id"), text("governance").alias("top"), text("governance/owners.json").alias("path"), F.when(F.col("id") == 8, text(owners(True))).otherwise(text(owners(False))).alias("text")),
        broken.select("repo_id", F.split_part("path", text("/"), text(1)).alias("top"), "path", "text"),
    ]
    out = files[0]
    for x in files[1:]:
        out = out.unionByName(x)
    return out.select("repo_id", "top", "path", F.col("text").cast("binary").alias("content"))


_kept: list[Records] = []


def _records(files: DataFrame, held: bool = False) -> Records:
    """Records over the files, kept until the next are made: what is dropped then is made anew where it is still asked for."""
    while _kept:
        _kept.pop().release()
    _kept.append(Records.of_files(files, held))
    return _kept[0]


def _query(sql: str, *ctes: str, held: bool = False):
    """held: the query reads texts of several kinds of files, so they are kept."""
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(_records(fleet(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")), held))
        SQL[f.__name__] = f"{_ctes(*ctes)}{sql}"
        return f

    return add


#: Manifests with all fields, and of those the ids that are known; what a repository's work can't be read by.
_WHOLE = """, whole AS (SELECT * FROM items WHERE whole),
sound AS (SELECT * FROM whole WHERE regexp_full_match(id, '[0-9]{3,}')), known AS (SELECT DISTINCT repo_id, id FROM sound)"""
_P = "SELECT repo_id, {} AS path, {} AS message, '{}' AS rule_id, {} AS subject FROM {}"
_NO_DAY = "NOT regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')"


@_query(_WHOLE + "\n" + "\nUNION ALL ".join([
    "SELECT 'r9' AS repo_id, '.' AS path, 'expected a JSON object: work/active/001-a/work-item.json' AS message, 'S1' AS rule_id, CAST(NULL AS VARCHAR) AS subject",
    _P.format("path", "'missing fields: title, updated'", "P2", "id", "items WHERE NOT whole"),
    _P.format("path", "'status ''' || status || ''' does not match directory ''' || folder || ''''", "P3", "id", "whole WHERE status <> folder"),
    _P.format("path", "'id must contain at least three digits'", "P4", "id", "whole WHERE NOT regexp_full_match(id, '[0-9]{3,}')"),
    _P.format("path", "'directory prefix must match work-item id'", "P5", "id", "whole WHERE k % 19 = 0"),
    *(_P.format("path", f"'{c} must be an ISO date'", "P7", "id", "whole WHERE " + _NO_DAY.format("created")) for c in ("created", "updated")),
    _P.format("path", "'duplicate id also used by ' || f", "W1", "id", "(SELECT *, row_number() OVER w AS n, first_value(path) OVER w AS f FROM sound WINDOW w AS (PARTITION BY repo_id, id ORDER BY place, path)) WHERE n > 1"),
    _P.format("parent", "'missing README.md narrative'", "P2", "id", "whole WHERE NOT noted"),
    _P.format("path", "'unknown owner_scope ''' || owner || ''''", "J4", "id", f"whole WHERE owner NOT IN {SCOPES}"),
    _P.format("path", "'unknown affected_scope ''' || other || ''''", "J4", "id", f"whole WHERE other NOT IN {SCOPES}"),
]), "items")
def rule_work(r: Records) -> DataFrame:
    return integrity.work(r, AS_OF)


_CRITERIA = """, criteria AS (SELECT i.repo_id, i.path, i.parent, i.id AS item, i.status, i.k, l.nth, l.cid, l.state, l.run, l.level, l.mark, l.boxed FROM (SELECT * FROM items WHERE whole) i JOIN lines l ON i.k = l.k)"""


@_query(_CRITERIA + "\n" + "\nUNION ALL ".join([
    _P.format("path", "'acceptance criterion IDs must be present and unique'", "W5", "item", "(SELECT *, row_number() OVER (PARTITION BY repo_id, path, cid ORDER BY nth) AS n FROM criteria) WHERE n > 1 OR cid = ''"),
    _P.format("path", "'criterion ' || cid || ' is satisfied without evidence'", "P8", "item", "criteria WHERE state = 'satisfied' AND run IS NULL"),
    _P.format("path", "'completed item has pending criterion ' || cid", "P9", "item", "criteria WHERE status = 'completed' AND state = 'pending'"),
    _P.format("path", "'criterion ' || cid || ' references unknown evidence ''' || run || ''''", "J3", "item", "criteria c WHERE run IS NOT NULL AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.repo_id = c.repo_id AND r.id = c.run)"),
]), "items", "lines", "runs")
def rule_criteria(r: Records) -> DataFrame:
    return integrity.criteria(r, AS_OF)


@_query(_CRITERIA + """, last AS (SELECT i.repo_id, i.parent, cid, arg_max(mark, nth) = 'x' AS ticked FROM items i JOIN lines l ON i.k = l.k WHERE noted AND boxed GROUP BY ALL),
noted AS (SELECT DISTINCT repo_id, parent FROM last),
c AS (SELECT criteria.*, concat(criteria.parent, '/README.md') AS readme, ticked FROM criteria JOIN noted USING (repo_id, parent) LEFT JOIN last USING (repo_id, parent, cid))
""" + "\nUNION ALL ".join([
    _P.format("readme", "'criterion ' || cid || ' has no checkbox in README'", "J14", "item", "c WHERE ticked IS NULL"),
    _P.format("readme", "'criterion ' || cid || ' is satisfied but its README checkbox is unchecked'", "J14", "item", "c WHERE state = 'satisfied' AND NOT ticked"),
    _P.format("readme", "'criterion ' || cid || ' is pending but its README checkbox is checked'", "J14", "item", "c WHERE state = 'pending' AND ticked"),
]), "items", "lines", held=True)
def rule_checkboxes(r: Records) -> DataFrame:
    return integrity.checkboxes(r, AS_OF)


@_query("\n" + _P.format("path", "'work item requires a preflight marker (enabled via governance/owners.json preflight.enabled)'", "P10", "id", "items WHERE whole AND NOT ready AND created > '1995-06-01'"), "items")
def rule_preflight(r: Records) -> DataFrame:
    return integrity.preflight(r, AS_OF)


@_query(_CRITERIA + """, of AS (SELECT repo_id, id, coalesce(arg_max(coalesce(level, 'concrete'), path), 'concrete') AS its FROM runs GROUP BY ALL),
done AS (SELECT c.*, coalesce(c.level, 'concrete') <> 'concrete' OR (run IS NOT NULL AND coalesce(its, 'concrete') <> 'concrete') AS soft FROM criteria c LEFT JOIN of ON of.repo_id = c.repo_id AND of.id = c.run WHERE state = 'satisfied'),
rests AS (SELECT repo_id, path, bool_or(soft) AS rests FROM done GROUP BY ALL),
own AS (SELECT items.*, coalesce(items.level, 'concrete') AS told, coalesce(rests, false) AS rests FROM items LEFT JOIN rests USING (repo_id, path) WHERE whole)
""" + "\nUNION ALL ".join([
    _P.format("path", "'completed item criterion ' || cid || ' rests on non-concrete evidence; ratchet it to concrete before completing (P2)'", "J15", "item", "done WHERE soft AND status = 'completed'"),
    _P.format("path", "'item provenance ''' || told || ''' cannot be completed; ratchet to concrete first (P2)'", "J15", "id", "own WHERE status = 'completed' AND told <> 'concrete'"),
    _P.format("path", "'concrete item rests on non-concrete evidence; mark it provisional/inferred or ratchet the evidence (P3)'", "J15", "id", "own WHERE status <> 'completed' AND told = 'concrete' AND rests"),
]), "items", "lines", "runs")
def rule_provenance(r: Records) -> DataFrame:
    return integrity.provenance(r, AS_OF)


_EDGES = """, edges AS (SELECT repo_id, path, id AS src, status, place, before AS dst, 0 AS pos FROM items WHERE before IS NOT NULL
  UNION ALL SELECT repo_id, path, id, status, place, itself, 0 FROM items WHERE itself IS NOT NULL UNION ALL SELECT repo_id, path, id, status, place, odd, 1 FROM items WHERE odd IS NOT NULL)"""


@_query(_WHOLE + _EDGES + """, of AS (SELECT repo_id, id AS dst, arg_max(status, (place, path)) AS its FROM items GROUP BY ALL),
own AS (SELECT e.*, k.id IS NOT NULL AS known, its FROM edges e LEFT JOIN known k ON k.repo_id = e.repo_id AND k.id = e.dst LEFT JOIN of ON of.repo_id = e.repo_id AND of.dst = e.dst)
""" + "\nUNION ALL ".join([
    _P.format("path", "'unknown dependency ''' || dst || ''''", "J1", "src", "own WHERE NOT known"),
    _P.format("path", "status || ' work item depends on proposed work item ''' || dst || '''; proposed work is not accepted implementation authority'", "J2", "src", "own WHERE known AND status IN ('active', 'completed') AND its = 'proposed'"),
]), "items")
def rule_dependencies(r: Records) -> DataFrame:
    return integrity.dependencies(r, AS_OF)


# Edges go from even to odd orders, to the next one and to the order itself, so cycles have one node or two; ids that
# several orders share could close longer ones, and none of them is an even order's number.
@_query(_WHOLE + _EDGES + """, e AS (SELECT repo_id, src, dst, min((place, path)) AS ord FROM edges SEMI JOIN known ON known.repo_id = edges.repo_id AND known.id = edges.dst GROUP BY repo_id, src, dst),
site AS (SELECT repo_id, id, arg_max(path, (place, path)) AS path FROM items GROUP BY ALL),
found AS (SELECT repo_id, src AS node, src || ' -> ' || src AS told FROM e WHERE src = dst
  UNION ALL SELECT a.repo_id, b.src, a.src || ' -> ' || b.src || ' -> ' || a.src FROM e a JOIN e b ON a.repo_id = b.repo_id AND a.src = b.dst AND a.dst = b.src WHERE a.src <> b.src AND a.ord < b.ord)
""" + _P.format("path", "'dependency cycle: ' || told", "G1", "node", "(SELECT found.repo_id, node, told, path FROM found JOIN site ON site.repo_id = found.repo_id AND site.id = node)"), "items")  # fmt: skip
def rule_cycles(r: Records) -> DataFrame:
    return integrity.cycles(r, AS_OF)


@_query(""", busy AS (SELECT DISTINCT repo_id, path, place, id, status, unnest(list_distinct([owner, other])) AS scope FROM items WHERE status IN ('active', 'blocked'))
SELECT a.repo_id, a.path, 'active scope conflict with ' || b.id || ' on ' || string_agg(a.scope, ', ' ORDER BY a.scope) AS message, 'J13' AS rule_id, CAST(NULL AS VARCHAR) AS subject
FROM busy a JOIN busy b ON a.repo_id = b.repo_id AND a.scope = b.scope AND (a.place, a.path) < (b.place, b.path) WHERE a.repo_id = 'r8' GROUP BY a.repo_id, a.path, b.path, b.id""", "items")
def rule_disjoint_scopes(r: Records) -> DataFrame:
    """Of the repositories that ask for it: pairs grow with the square of a scope's items, so a small one does."""
    return integrity.disjoint_scopes(r, AS_OF)


@_query("\n" + _P.format("path", "'work directory holds planning content (README/AGENTS/_audit) but no work-item.json; it is invisible to the ledger, validator and dashboard'", "J18", "CAST(NULL AS VARCHAR)", "strays WHERE shown"), "strays")
def rule_orphans(r: Records) -> DataFrame:
    return integrity.orphans(r, AS_OF)


@_query(""", whole_runs AS (SELECT * FROM runs WHERE whole), known AS (SELECT DISTINCT repo_id, id FROM items WHERE whole AND regexp_full_match(id, '[0-9]{3,}'))
""" + "\nUNION ALL ".join([
    _P.format("path", "'missing evidence fields: result'", "P2", "id", "runs WHERE NOT whole"),
    _P.format("path", "'evidence id must match filename'", "P6", "id", "whole_runs WHERE k % 7 = 0"),
    _P.format("path", "'timestamp must be ISO 8601'", "P7", "id", "whole_runs WHERE stamp = 'yesterday'"),
    _P.format("path", "'duplicate evidence id also used by ' || f", "W1", "id", "(SELECT *, lag(path) OVER (PARTITION BY repo_id, id ORDER BY path) AS f FROM whole_runs) WHERE f IS NOT NULL"),
    _P.format("path", "'unknown work_item ''' || item || ''''", "J5", "id", "whole_runs w WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.repo_id = w.repo_id AND known.id = w.item)"),
]), "items", "runs")
def rule_evidence(r: Records) -> DataFrame:
    return integrity.evidence(r, AS_OF)


_REPOS = "(SELECT DISTINCT repo_id FROM (SELECT repo_id FROM items UNION ALL SELECT repo_id FROM runs UNION ALL SELECT concat('r', unnest(range(9)))) UNION ALL SELECT 'r9')"


@_query(f"""\nSELECT s.repo_id, status, count(i.k) AS n FROM (SELECT repo_id, unnest(['proposed', 'active', 'blocked', 'deferred', 'completed']) AS status FROM {_REPOS}) s
LEFT JOIN items i USING (repo_id, status) GROUP BY ALL""", "items", "runs")
def report_status_counts(r: Records) -> DataFrame:
    return report.status_counts(r)


@_query(_CRITERIA + """, of AS (SELECT repo_id, id, arg_max(coalesce(level, 'concrete'), path) AS its FROM runs GROUP BY ALL),
soft AS (SELECT DISTINCT c.repo_id, path FROM criteria c LEFT JOIN of ON of.repo_id = c.repo_id AND of.id = c.run WHERE state = 'satisfied' AND run IS NOT NULL AND coalesce(its, 'concrete') <> 'concrete')
SELECT repo_id, path, id, 'concrete' AS provenance FROM items WHERE level = 'provisional' AND NOT EXISTS (SELECT 1 FROM soft WHERE soft.repo_id = items.repo_id AND soft.path = items.path AND items.whole)""", "items", "lines", "runs")
def doctor_ratchet(r: Records) -> DataFrame:
    return doctor.ratchet(r)


@_query(f"""\nSELECT s.repo_id, lpad(concat('', coalesce(max(CASE WHEN k % 19 <> 0 THEN CAST(id AS BIGINT) END), 0) + 1), greatest(3, length(concat('', coalesce(max(CASE WHEN k % 19 <> 0 THEN CAST(id AS BIGINT) END), 0) + 1)))::INTEGER, '0') AS next_id
FROM {_REPOS} s LEFT JOIN items USING (repo_id) WHERE s.repo_id <> 'r9' GROUP BY s.repo_id UNION ALL SELECT 'r9', '003'""", "items", "runs")
def adoption_next_ids(r: Records) -> DataFrame:
    return adoption.next_ids(r, "work")
