"""Facts that research documents share with their metadata: freshness, lifecycle, counts, ranges, threats, traces.

The rules hold where a repository has the metadata, or both a paper and a protocol. Patterns are data, one for each
document, and are applied where the document is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as t
from recordloom.model import STATUSES
from recordloom.operators import relational as ops
from recordloom.sources.records import Records

META = "research/metadata.json"
SCHEMA = """version bigint,
claim_freshness struct<policy: string, last_reviewed: string, next_review: string, documents: array<string>>,
lifecycle struct<states: array<string>, set_documents: array<struct<path: string, pattern: string>>, figure_documents: array<struct<path: string, section: string>>>,
benchmark struct<task_count: bigint, documents: array<struct<path: string, pattern: string>>, study_hypotheses: map<string, string>,
range_documents: array<struct<path: string, pattern: string>>, mapping_documents: array<string>>,
threats struct<ids: array<string>, pattern: string, documents: array<string>>,
proposed_state_trace array<struct<path: string, tokens: array<string>>>"""
#: Days between two reviews at most.
CADENCE = 30


def _say(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts))


def metadata(r: Records) -> DataFrame:
    own = r.one(META).select("repo_id", "path", F.from_json("text", SCHEMA).alias("m"), F.json_object_keys("text").alias("keys"))
    return own


def _documents(r: Records) -> DataFrame:
    return r.files.where(F.col("path").endswith(".md")).select("repo_id", F.col("path").alias("doc"), "text")


def facts(r: Records, as_of: str) -> DataFrame:
    m = metadata(r)
    both = r.one("research/paper.md").select("repo_id").join(r.one("research/protocol.md").select("repo_id"), "repo_id")
    none = ops.problems(both.join(m.select("repo_id"), "repo_id", "left_anti").withColumn("path", F.lit(META)), ("P33", F.lit(True), "missing research metadata"))
    odd = ops.problems(m, ("S28", F.col("keys").isNull(), "expected a JSON object"))
    m = m.where("keys is not null").select("repo_id", "path", "m.*")
    return ops.union_all([none, odd, freshness(r, m, as_of), lifecycle(r, m), benchmark(r, m), threats(r, m), traces(r, m)])


def freshness(r: Records, m: DataFrame, as_of: str) -> DataFrame:
    """Dates in order, at most CADENCE days apart and not past; the declared documents are those that there are, once each."""
    own = m.select("repo_id", "path", "claim_freshness.*")
    last, due = F.col("last_reviewed").try_cast("date"), F.col("next_review").try_cast("date")
    dated = {c: t.is_date(F.coalesce(c, F.lit("None"))) for c in ("last_reviewed", "next_review")}
    sound = dated["last_reviewed"] & dated["next_review"]
    local = ops.problems(
        own,
        *(("P20", ~ok, f"claim_freshness {c} must be an ISO date") for c, ok in dated.items()),
        ("P20", sound & (due < last), "claim review deadline precedes its last review"),
        ("P20", sound & (F.date_diff(due, last) > CADENCE), f"claim review cadence exceeds {CADENCE} days"),
        ("P20", sound & (due < F.lit(as_of).cast("date")), _say("research claims expired on ", due)),
        ("A3", F.size("documents") != F.size(F.array_distinct("documents")), "claim documents must be unique"),
    )
    lost = own.select("repo_id", "path", F.col("policy").alias("at")).join(r.files.select("repo_id", F.col("path").alias("at")), ["repo_id", "at"], "left_anti")
    lost = ops.problems(lost, ("P20", F.lit(True), _say("claim freshness policy does not exist: ", F.col("at"))))
    there = r.files.where("parent = 'research' and name like '%.md'").join(own.select("repo_id"), "repo_id", "left_semi").select("repo_id", F.col("path").alias("doc"))
    sides = ops.coverage(own.select("repo_id", F.explode("documents").alias("doc")), there, ["repo_id", "doc"]).withColumn("path", F.lit(META))
    return ops.union_all([local, lost, ops.problems(sides, ("J23", F.col("side") == "left", _say("declared claim document does not exist: ", F.col("doc"))), ("J23", F.col("side") == "right", _say("claim document is not declared: ", F.col("doc"))))])


def _with_text(r: Records, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared documents (repo_id, path, doc, ...) with their texts, and problems of those that aren't there."""
    own = declared.join(_documents(r), ["repo_id", "doc"], "left")
    gone = ops.problems(own.drop("path").withColumnRenamed("doc", "path"), ("S28", F.col("text").isNull(), "declared research document does not exist"))
    return own.where("text is not null"), gone


def lifecycle(r: Records, m: DataFrame) -> DataFrame:
    canonical = F.array(*map(F.lit, STATUSES))
    own = m.where("lifecycle is not null").select("repo_id", "path", "lifecycle.*")
    other = ops.problems(own, ("P21", ~F.col("states").eqNullSafe(canonical), f"canonical lifecycle states must be: {', '.join(STATUSES)}"))
    same = own.where(F.col("states") == canonical)
    sets, gone1 = _with_text(r, same.select("repo_id", "path", "states", F.explode("set_documents").alias("d")).select("repo_id", "path", "states", F.col("d.path").alias("doc"), "d.pattern"))
    found = F.expr("regexp_extract_all(text, pattern, 1)")
    seen = F.transform(F.split(found[0], ","), lambda x: F.trim(F.regexp_replace(F.trim(x), "^`+|`+$", "")))
    sets = sets.withColumns({"n": F.size(found), "seen": F.when(F.size(found) > 0, seen)})
    listed = ops.problems(sets, ("P21", F.col("n") == 0, "canonical lifecycle set is missing"), ("P21", (F.col("n") > 0) & (F.col("seen") != F.col("states")), _say("lifecycle states contradict metadata: expected ", F.array_join("states", ", "), "; observed ", F.array_join("seen", ", "))), path="doc")
    figures, gone2 = _with_text(r, same.select("repo_id", "path", "states", F.explode("figure_documents").alias("d")).select("repo_id", "path", "states", F.col("d.path").alias("doc"), "d.section"))
    body = figures.withColumn("body", t.section("text", F.col("section")))
    body = body.withColumn("diagram", t.fenced("body"))
    missing = F.filter("states", lambda s: ~F.regexp_like(F.col("diagram"), F.concat(F.lit("\\b"), s, F.lit("\\b"))))
    drawn = ops.problems(body, ("P21", F.col("body").isNull(), _say("missing lifecycle section '", F.col("section"), "'")), ("P21", F.col("body").isNotNull() & (F.size(missing) > 0), _say("lifecycle figure contradicts metadata; missing state(s): ", F.array_join(missing, ", "))), path="doc")
    return ops.union_all([other, gone1, gone2, listed, drawn])


def benchmark(r: Records, m: DataFrame) -> DataFrame:
    own = m.where("benchmark is not null").select("repo_id", "path", "benchmark.*")
    counts, gone1 = _with_text(r, own.select("repo_id", "path", "task_count", F.explode("documents").alias("d")).select("repo_id", "path", "task_count", F.col("d.path").alias("doc"), "d.pattern"))
    n = F.expr("regexp_extract(text, pattern, 1)")
    counts = counts.withColumn("seen", n.try_cast("bigint"))
    counted = ops.problems(counts, ("P22", F.col("seen").isNull(), "task-count fact is missing"), ("P22", F.col("seen") != F.col("task_count"), _say("task count contradicts metadata: expected ", F.col("task_count"), "; observed ", F.col("seen"))), path="doc")
    numbers = F.transform(F.map_values("study_hypotheses"), lambda x: F.substring(x, 2, 9).cast("int"))
    ranges = own.where(F.size("study_hypotheses") > 0).select("repo_id", "path", F.array_min(numbers).alias("low"), F.array_max(numbers).alias("high"), F.explode("range_documents").alias("d"))
    ranges, gone2 = _with_text(r, ranges.select("repo_id", "path", "low", "high", F.col("d.path").alias("doc"), "d.pattern"))
    ranges = ranges.withColumns({"a": F.expr("regexp_extract(text, pattern, 1)").try_cast("int"), "b": F.expr("regexp_extract(text, pattern, 2)").try_cast("int")})
    ranged = ops.problems(ranges, ("P22", F.col("a").isNull(), "benchmark hypothesis range is missing"), ("P22", (F.col("a") != F.col("low")) | (F.col("b") != F.col("high")), _say("benchmark hypothesis range contradicts metadata: expected H", F.col("low"), "–H", F.col("high"), "; observed H", F.col("a"), "–H", F.col("b"))), path="doc")
    maps, gone3 = _with_text(r, own.select("repo_id", "path", F.array_sort(F.map_entries("study_hypotheses")).alias("want"), F.explode("mapping_documents").alias("doc")))
    heads, rows = r"(?m)^###\s+(S[0-9]+)\b[^\n]*[→-]+\s*(H[0-9]+)\b", r"(?m)^\|\s*(S[0-9]+)\s*\|\s*(H[0-9]+)\s*\|"
    pairs = lambda p: F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("key"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("value"))
    maps = maps.withColumn("seen", F.array_sort(F.array_distinct(F.when(F.size(pairs(heads)) > 0, pairs(heads)).otherwise(pairs(rows)))))
    mapped = ops.problems(maps, ("J31", F.to_json("seen") != F.to_json("want"), _say("study-to-hypothesis mapping contradicts metadata: expected ", F.to_json("want"), "; observed ", F.to_json("seen"))), path="doc")
    return ops.union_all([gone1, gone2, gone3, counted, ranged, mapped])


def threats(r: Records, m: DataFrame) -> DataFrame:
    """Each document has each threat once."""
    own = m.where("threats is not null").select("repo_id", "path", "threats.*")
    twice = ops.problems(own, ("A3", F.size("ids") != F.size(F.array_distinct("ids")), "threat ids must be unique"))
    docs, gone = _with_text(r, own.select("repo_id", "path", "ids", "pattern", F.explode("documents").alias("doc")))
    seen = docs.select("repo_id", "doc", F.explode(F.expr("regexp_extract_all(text, pattern, 1)")).alias("id")).groupBy("repo_id", "doc", "id").agg(F.count("*").alias("n"))
    want = docs.select("repo_id", "doc", F.explode(F.array_distinct("ids")).alias("id"), F.lit(True).alias("known"))
    sides = want.join(seen, ["repo_id", "doc", "id"], "full_outer")
    return ops.union_all([twice, gone, ops.problems(
        sides,
        ("J24", F.col("n") > 1, _say("threat is repeated: ", F.col("id"))),
        ("J24", F.col("n").isNull(), _say("threat is missing: ", F.col("id"))),
        ("J24", F.col("known").isNull(), _say("unexpected threat: ", F.col("id"))),
        path="doc",
    )])


def traces(r: Records, m: DataFrame) -> DataFrame:
    each = m.select("repo_id", "path", F.explode("proposed_state_trace").alias("e")).select("repo_id", "path", F.col("e.path").alias("at"), "e.tokens")
    own = each.join(r.files.select("repo_id", F.col("path").alias("at"), "text"), ["repo_id", "at"], "left")
    lost = F.filter("tokens", lambda x: ~F.contains(F.col("text"), x))
    return ops.problems(own, ("P23", F.col("text").isNull(), _say("trace target does not exist: ", F.col("at"))), ("P23", F.col("text").isNotNull() & (F.size(lost) > 0), _say("trace target ", F.col("at"), " lacks: ", F.array_join(lost, ", "))))
