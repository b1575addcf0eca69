"""Queries over the driver's tables, by the same operators as the record rules, and the same rows in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as t
from recordloom.operators import graph, relational as ops

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Fixed in the queries: the day that rules of freshness are asked for, and an ownership map of part names.
AS_OF = "2000-06-01"
GLOBS = (("colours", "red *"), ("colours", "blue *"), ("sizes", "small *"), ("sizes", "large *"), ("widgets", "*widget"), ("b-things", "[ab]l?e *"))


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)
        SQL[f.__name__] = sql
        return f

    return add


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(table, spark: SparkSession) -> DataFrame:
    return ops.duplicates(table("lineitem"), ["l_orderkey", "l_linenumber"])


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p AS first_partkey FROM (
  SELECT *, row_number() OVER w AS k, first_value(l_partkey) OVER w AS p FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)) WHERE k > 1""")
def later_occurrences(table, spark: SparkSession) -> DataFrame:
    order = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    return ops.later_occurrences(table("lineitem"), ["l_orderkey", "l_linenumber"], order, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("other").alias("first_partkey"))


@_query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_shipdate < o_orderdate GROUP BY l_orderkey, l_linenumber""")
def dates_out_of_order(table, spark: SparkSession) -> DataFrame:
    lines, orders = table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), table("orders").select("o_orderkey", "o_orderdate")
    # A join sorts what a task holds, so that isn't left to the size of the shuffled bytes.
    n = ops.tasks_for(lines)
    lines, orders = lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).where("l_shipdate < o_orderdate").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


def _steps(table) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table("events").select(F.lag("event_type").over(w).alias("src"), F.col("event_type").alias("dst")).where("src is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


@_query("""WITH RECURSIVE s AS (SELECT DISTINCT src, dst FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst FROM events) WHERE src IS NOT NULL),
r(src, dst) AS (SELECT src, dst FROM s UNION SELECT r.src, s.dst FROM r JOIN s ON r.dst = s.src)
SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""")
def event_cycles(table, spark: SparkSession) -> DataFrame:
    edges = _steps(table).select(F.lit("events").alias("repo_id"), "src", "dst")
    return graph.on_cycles(edges).select("node", "component")


@_query(r"SELECT doc_id, v AS version, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+(?:\.[0-9]+)?')) AS v FROM documents) GROUP BY ALL")
def version_tokens(table, spark: SparkSession) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return table("documents").select("doc_id", F.explode(found).alias("version")).groupBy("doc_id", "version").agg(F.count("*").alias("n"))


@_query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slug_part_names(table, spark: SparkSession) -> DataFrame:
    return table("part").select("p_partkey", t.slug(F.concat("p_name", F.lit(" "), "p_brand")).alias("slug"))


@_query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(table, spark: SparkSession) -> DataFrame:
    return ops.duplicates(table("documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest")), ["digest"])


@_query("SELECT page_id, CAST(len(regexp_extract_all(html, 'href=\"')) AS INTEGER) AS links FROM pages")
def link_counts(table, spark: SparkSession) -> DataFrame:
    return table("pages").select("page_id", F.regexp_count("html", F.lit('href="')).alias("links"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_extract(table, spark: SparkSession) -> DataFrame:
    return table("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@_query("""WITH g(id, pat) AS (VALUES """ + ", ".join(f"('{i}', '{g}')" for i, g in GLOBS) + """),
h AS (SELECT DISTINCT p_partkey, p_name, id FROM part LEFT JOIN g ON p_name GLOB pat)
SELECT p_partkey, p_name, count(id) AS n_owners, coalesce(string_agg(id, ', ' ORDER BY id), '') AS owners FROM h GROUP BY p_partkey, p_name HAVING count(id) <> 1""")
def glob_ownership(table, spark: SparkSession) -> DataFrame:
    named = ops.owners_of(F.col("p_name"), [(i, t.glob_regex(g), t.glob_head(g)) for i, g in GLOBS])
    out = table("part").select("p_partkey", "p_name", named.alias("owners"))
    return out.where(F.size("owners") != 1).select("p_partkey", "p_name", F.size("owners").cast("bigint").alias("n_owners"), F.array_join("owners", ", ").alias("owners"))


@_query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS said FROM conversations""")
def carry_forward(table, spark: SparkSession) -> DataFrame:
    return ops.carry_forward(table("conversations"), ["conv_id"], ["turn"], F.col("role") == "system", F.col("text"), "said").select("conv_id", "turn", "role", "said")


@_query(f"""SELECT c_custkey, CAST(max(o_orderdate) AS DATE) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey
  GROUP BY c_custkey HAVING max(o_orderdate) IS NULL OR max(o_orderdate) < TIMESTAMP '{AS_OF}'""")
def stale_entities(table, spark: SparkSession) -> DataFrame:
    last = table("orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("last_order"))
    customers = table("customer").select("c_custkey")
    out = customers.join(last, customers.c_custkey == last.o_custkey, "left").select("c_custkey", "last_order")
    return out.where(F.col("last_order").isNull() | (F.col("last_order") < F.lit(AS_OF).cast("date")))


@_query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def dangling_refs(table, spark: SparkSession) -> DataFrame:
    known = table("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return ops.dangling(table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), known, ["l_orderkey"])


@_query("""SELECT s AS status, p AS priority, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s), (SELECT DISTINCT o_orderpriority AS p FROM orders)
  LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_orderstatus = s AND o_orderpriority = p GROUP BY ALL""")
def status_zero_filled(table, spark: SparkSession) -> DataFrame:
    orders = table("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    states = F.explode(F.array(*map(F.lit, "FOPX"))).alias("status")
    return ops.zero_filled(orders.where("o_totalprice > 400000"), orders.select("priority").distinct().select(states, "priority"), ["status", "priority"])


@_query("""WITH m AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber AS "left", b.l_linenumber AS "right", string_agg(CAST(a.l_suppkey AS VARCHAR), ',' ORDER BY a.l_suppkey) AS shared
FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber GROUP BY ALL""")
def overlap_pairs(table, spark: SparkSession) -> DataFrame:
    members = table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_linenumber").alias("ord"))
    return ops.overlaps(members, ["l_orderkey"], "l_linenumber", "l_suppkey", "ord").select("l_orderkey", "left", "right", F.array_join(F.transform("shared", lambda x: x.cast("string")), ",").alias("shared"))


@_query("""SELECT o_orderkey, count(*) AS open_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE o_orderstatus = 'F' AND l_linestatus = 'O' GROUP BY o_orderkey""")
def completeness_conditional(table, spark: SparkSession) -> DataFrame:
    orders = table("orders").where("o_orderstatus = 'F'").select("o_orderkey")
    still = ops.counted(table("lineitem").where("l_linestatus = 'O'").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], "open_lines")
    return orders.join(still, "o_orderkey")


@_query("""SELECT coalesce(CASE quality WHEN 1 THEN 'concrete' WHEN 0 THEN 'provisional' END, 'unlabelled') AS provenance, count(*) AS n
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def provenance_default(table, spark: SparkSession) -> DataFrame:
    level = F.when(F.col("quality") == 1, "concrete").when(F.col("quality") == 0, "provisional")
    return table("documents").select("doc_id").join(table("labels"), "doc_id", "left").groupBy(F.coalesce(level, F.lit("unlabelled")).alias("provenance")).agg(F.count("*").alias("n"))


@_query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' WHEN d.doc_id IS NULL THEN 'right' ELSE 'both' END AS side
  FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def full_outer_coverage(table, spark: SparkSession) -> DataFrame:
    return ops.coverage(table("documents"), table("labels"), ["doc_id"])


@_query("""SELECT o_orderkey, count(*) AS n_lines, count(*) FILTER (WHERE l_linestatus = 'O') AS n_open, CAST(min(l_shipdate) AS DATE) AS first_ship
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def nested_record_build(table, spark: SparkSession) -> DataFrame:
    lines = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_linestatus", "l_shipdate")).alias("lines"))
    record = table("orders").select("o_orderkey").join(lines, "o_orderkey")
    still = F.size(F.filter("lines", lambda x: x["l_linestatus"] == "O")).cast("bigint")
    return record.select("o_orderkey", F.size("lines").cast("bigint").alias("n_lines"), still.alias("n_open"), F.array_min("lines.l_shipdate").cast("date").alias("first_ship"))


@_query("SELECT lpad(CAST(max(s_suppkey) + 1 AS VARCHAR), greatest(6, length(CAST(max(s_suppkey) + 1 AS VARCHAR))::INTEGER), '0') AS next_id FROM supplier")
def max_plus_one(table, spark: SparkSession) -> DataFrame:
    return ops.next_id(table("supplier"), "s_suppkey", 6)


@_query("""SELECT value, rank FROM (SELECT value, row_number() OVER (ORDER BY value) AS rank FROM (SELECT unnest(range(1, (SELECT max(p_partkey) + 10 FROM part))) AS value)
  WHERE value NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)) WHERE rank <= 5""")
def first_gap(table, spark: SparkSession) -> DataFrame:
    return ops.missing_values(table("part").where("p_size > 10"), "p_partkey", 1, 5).withColumn("rank", F.col("rank").cast("bigint"))


@_query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') OR event_type IS NULL GROUP BY event_type")
def enum_domain(table, spark: SparkSession) -> DataFrame:
    known = F.coalesce(F.col("event_type").isin("view", "click", "purchase"), F.lit(False))
    return table("events").where(~known).groupBy("event_type").agg(F.count("*").alias("n"))


@_query("SELECT p_partkey, p_brand FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[1-9]')")
def pattern_check(table, spark: SparkSession) -> DataFrame:
    return table("part").where(~F.col("p_brand").rlike(r"^(?:Brand#[1-9])\z")).select("p_partkey", "p_brand")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")


@_query(" UNION ALL ".join(f"SELECT '{x}' AS metric, count(*) AS n FROM {x}" for x in _TABLES))
def dashboard_counts(table, spark: SparkSession) -> DataFrame:
    return ops.union_all([table(x).agg(F.lit(x).alias("metric"), F.count("*").alias("n")) for x in _TABLES])


@_query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey""")
def first_and_last_wins(table, spark: SparkSession) -> DataFrame:
    return ops.first_and_last_by(table("orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), "o_orderkey", "first_order", "last_order")


_FOLDERS = (("/en", "english"), ("/en/1", "first english"), ("/de", "german"))


@_query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f(prefix, owner) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in _FOLDERS) + """)
SELECT page_id, path, arg_max(owner, length(prefix)) AS owner FROM u LEFT JOIN f ON path = prefix OR starts_with(path, prefix || '/') GROUP BY page_id, path""")
def most_specific_folder(table, spark: SparkSession) -> DataFrame:
    pages = table("pages").select("page_id", F.regexp_extract("url", "^[^:]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return ops.most_specific(pages, spark.createDataFrame(_FOLDERS, "prefix string, owner string"), "path", "prefix", "owner").select("page_id", "path", "owner")


@_query("""SELECT 'driver' AS repo_id, 'lineitem' AS path, 'key ' || l_orderkey || '-' || l_linenumber || ' occurs ' || n || ' times' AS message, 'duplicate_keys' AS rule_id, CAST(l_orderkey AS VARCHAR) AS subject
  FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'driver', 'lineitem', 'line ' || l_linenumber || ' ships before its order, ' || n || ' times', 'dates_out_of_order', CAST(l_orderkey AS VARCHAR)
  FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate GROUP BY l_orderkey, l_linenumber)
UNION ALL SELECT 'driver', 'orders', 'filled order has ' || n || ' open lines', 'completeness_conditional', CAST(o_orderkey AS VARCHAR)
  FROM (SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_linestatus = 'O' GROUP BY o_orderkey)""")
def record_problems(table, spark: SparkSession) -> DataFrame:
    """The flagship: problems of three rules as one relation."""

    def as_problems(rows, rule, path, message, subject):
        return ops.problems(rows.withColumn("repo_id", F.lit("driver")).withColumn("path", F.lit(path)), (rule, F.lit(True), message), subject=subject)

    return ops.union_all([
        as_problems(duplicate_keys(table, spark), "duplicate_keys", "lineitem", F.format_string("key %d-%d occurs %d times", "l_orderkey", "l_linenumber", "n"), "l_orderkey"),
        as_problems(dates_out_of_order(table, spark), "dates_out_of_order", "lineitem", F.format_string("line %d ships before its order, %d times", "l_linenumber", "n"), "l_orderkey"),
        as_problems(completeness_conditional(table, spark), "completeness_conditional", "orders", F.format_string("filled order has %d open lines", "open_lines"), "o_orderkey"),
    ])
