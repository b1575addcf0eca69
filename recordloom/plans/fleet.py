"""Verification of a fleet of adopters against tables of what their remotes hold.

remote_head: (repository, branch, head); remote_file: (repository, revision, path, content); checkouts: (url, path,
marked) of local clones. All adopters are verified at once; a missing row is an error of that adopter alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as t
from recordloom.operators import relational as ops
from recordloom.operators.patches import apply_patch
from recordloom.plans.integrity import say
from recordloom.sources.records import Records


def adopters(r: Records) -> DataFrame:
    each = r.adopters.select("repo_id", F.col("data.upstream.repository").alias("upstream"), F.col("data.upstream.package").alias("package"), F.explode("data.adopters").alias("a"))
    return each.select("repo_id", "upstream", "package", "a.*").withColumn("key", t.repo_key("repository"))


def consumers(checkouts: DataFrame) -> DataFrame:
    """key, paths (sorted) and marked of local clones by the remote that they come from; others are left out."""
    own = checkouts.withColumn("key", t.repo_key(t.canonical_remote("url"))).where("key is not null")
    return own.groupBy("key").agg(F.sort_array(F.collect_set("path")).alias("paths"), F.bool_or("marked").alias("marked"))


def unregistered(r: Records, checkouts: DataFrame) -> DataFrame:
    return consumers(checkouts).where("marked").join(adopters(r).select("key").distinct(), "key", "left_anti")


def vendored(r: Records, remote_file: DataFrame, own: DataFrame) -> DataFrame:
    """repo_id, id, kind (check or error) and said, of files that adopters hold copies of. own: adopters with head and release."""
    each = own.where("consumption.type = 'vendored'").select("repo_id", "id", "repository", "upstream", "head", "consumption.upstream_revision", F.explode("consumption.files").alias("f")).select("*", "f.*").drop("f")
    files = remote_file.select("repository", "revision", "path", "content")
    up = files.select(F.col("repository").alias("upstream"), F.col("revision").alias("upstream_revision"), F.col("path").alias("upstream_path"), F.col("content").alias("theirs"))
    mine = files.select("repository", F.col("revision").alias("head"), F.col("path").alias("adopter_path"), F.col("content").alias("mine"))
    over = r.files.select("repo_id", F.col("path").alias("overlay_at"), t.unix_ends("content").alias("patch"))
    each = each.withColumn("overlay_at", F.when(F.col("mode") == "overlay", t.normal_path("overlay_path")))
    each = each.join(up, ["upstream", "upstream_revision", "upstream_path"], "left").join(mine, ["repository", "head", "adopter_path"], "left").join(over, ["repo_id", "overlay_at"], "left")
    each = each.withColumns({"up_sha": F.sha2("theirs", 256), "my_sha": F.sha2("mine", 256), "over_sha": F.sha2("patch", 256), "made": F.when(F.col("mode") == "overlay", apply_patch("theirs", "patch"))})
    label, has = F.concat("adopter_path", F.lit(": ")), F.col("theirs").isNotNull() & F.col("mine").isNotNull()
    is_over = (F.col("mode") == "overlay") & has
    told = [
        ("error", ~has, say(label, "file is missing")),
        ("error", has & (F.col("up_sha") != F.col("upstream_sha256")), say(label, "upstream checksum drift (", F.col("up_sha"), ")")),
        ("error", has & (F.col("my_sha") != F.col("adopter_sha256")), say(label, "adopter checksum drift (", F.col("my_sha"), ")")),
        ("error", has & (F.col("mode") == "exact") & (F.col("theirs") != F.col("mine")), say(label, "declared exact copy differs from upstream")),
        ("check", has & (F.col("mode") == "exact") & (F.col("theirs") == F.col("mine")) & (F.col("up_sha") == F.col("upstream_sha256")), say("exact checksum parity: ", F.col("adopter_path"))),
        ("error", is_over & F.col("patch").isNull(), say(label, "overlay is missing")),
        ("error", is_over & (F.col("over_sha") != F.col("overlay_sha256")), say(label, "overlay checksum drift")),
        ("error", is_over & F.col("made.error").isNotNull(), say(label, "overlay cannot be applied: ", F.col("made.error"))),
        ("error", is_over & (F.col("made.content") != F.col("mine")), say(label, "reviewable overlay does not reconstruct adopter bytes")),
        ("check", is_over & (F.col("made.content") == F.col("mine")) & (F.col("my_sha") == F.col("adopter_sha256")), say("reviewable overlay parity: ", F.col("adopter_path"))),
    ]
    return _told(each, told)


def _told(rows: DataFrame, told: list) -> DataFrame:
    found = [F.when(c, F.struct(F.lit(k).alias("kind"), m.alias("said"))) for k, c, m in told]
    return rows.withColumn("_t", F.explode(F.array_compact(F.array(*found)))).select("repo_id", "id", "_t.kind", "_t.said")


def verify(r: Records, remote_head: DataFrame, remote_file: DataFrame, checkouts: DataFrame) -> DataFrame:
    """One row for each adopter, in order of its repository: head, declared version, checks, errors, checkouts and ok."""
    own = adopters(r).join(r.text_of("VERSION", "release"), "repo_id", "left")
    own = own.join(remote_head.select("repository", F.col("branch").alias("default_branch"), "head"), ["repository", "default_branch"], "left")
    marker = remote_file.select("repository", F.col("revision").alias("head"), F.col("path").alias("version_file"), F.decode("content", "UTF-8").alias("marker"))
    own = own.withColumn("version_file", F.col("consumption.version_file")).join(marker, ["repository", "head", "version_file"], "left")
    pins = F.expr(r"regexp_extract_all(marker, concat('(?m)^[ \\t]*[\'\"]?', package, '==([0-9]+\\.[0-9]+\\.[0-9]+)'), 1)")
    is_pin, line = F.col("consumption.type") == "pypi", F.trim(F.regexp_replace("marker", r"^\s+|\s+\z", ""))
    own = own.withColumns({"pins": pins, "declared": F.when(is_pin, F.when(F.size(pins) == 1, F.element_at(pins, 1))).otherwise(line)})
    has = F.col("head").isNotNull() & F.col("marker").isNotNull()
    local = _told(own, [
        ("error", F.col("head").isNull(), say("branch can't be resolved: ", F.col("default_branch"))),
        ("check", F.col("head").isNotNull(), say("public branch resolved: ", F.col("head"))),
        ("error", F.col("head").isNotNull() & F.col("marker").isNull(), say("version file is missing: ", F.col("version_file"))),
        ("error", has & is_pin & (F.size("pins") != 1), say("version file must contain one exact ", F.col("package"), "==X.Y.Z pin")),
        ("check", has & is_pin & (F.size("pins") == 1), say("exact pin: ", F.col("package"), "==", F.col("declared"))),
        ("error", has & ~is_pin & ~F.col("declared").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\z"), say("vendored version marker must contain one semantic version")),
        ("error", has & ~is_pin & (F.col("consumption.upstream_version") != F.col("release")), say("vendored upstream_version ", F.col("consumption.upstream_version"), " does not match current release ", F.col("release"))),
        ("error", has & (F.col("declared") != F.col("release")), say("declared version ", F.col("declared"), " is stale; current release is ", F.col("release"))),
    ])
    told = local.unionByName(vendored(r, remote_file, own.where(has))).groupBy("repo_id", "id").agg(F.sort_array(F.collect_list(F.when(F.col("kind") == "check", F.col("said")))).alias("checks"), F.sort_array(F.collect_list(F.when(F.col("kind") == "error", F.col("said")))).alias("errors"))
    out = own.join(told, ["repo_id", "id"], "left").join(consumers(checkouts).drop("marked"), "key", "left")
    none = F.array().cast("array<string>")
    return out.select("repo_id", "id", "repository", "default_branch", "head", F.col("consumption.type").alias("consumption"), "declared", "release", F.coalesce("paths", none).alias("local_checkouts"), F.coalesce("checks", none).alias("checks"), F.coalesce("errors", none).alias("errors"), (F.size(F.coalesce("errors", none)) == 0).alias("ok")).orderBy("repo_id", F.lower("repository"))


def fleet_ok(verified: DataFrame) -> DataFrame:
    """repo_id, n and ok: a fleet is sound if it has adopters and all are."""
    return verified.groupBy("repo_id").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok"))


def closeout(r: Records, verified: DataFrame, package: DataFrame) -> DataFrame:
    """repo_id and errors of a release: package (repo_id, result, release, url, artifacts) is its evidence."""
    own = r.repos.join(r.text_of("VERSION", "v"), "repo_id", "left").join(package, "repo_id", "left").join(fleet_ok(verified), "repo_id", "left")
    same = F.array_contains(F.transform("artifacts", lambda x: F.rtrim(x, F.lit("/"))), F.rtrim("url", F.lit("/")))
    found = [
        F.when(F.col("result").isNull(), "package evidence is missing"),
        F.when(F.col("result") != "passed", "package evidence did not pass"),
        F.when(F.col("release") != F.col("v"), "package evidence is of another release"),
        F.when(~same, "package evidence lacks the published artifact"),
        F.when(~F.coalesce("ok", F.lit(False)), "fleet verification failed"),
    ]
    return own.select("repo_id", F.array_compact(F.array(*found)).alias("errors"))


def archive_problems(members: DataFrame, expected: dict[str, int], flat: tuple[str, ...] = ()) -> DataFrame:
    """Problems of archives (archive, member): one top folder beside metadata, so many members below each of `expected`, none of `flat`."""
    top = F.split_part("member", F.lit("/"), F.lit(1))
    counts = [F.count_if(F.startswith("member", F.lit(k))).alias(f"n{i}") for i, k in enumerate(expected)]
    own = members.groupBy("archive").agg(F.count_distinct(F.when(~top.rlike(r"\.(dist-info|data)\z"), top)).alias("tops"), F.sort_array(F.collect_set(F.when(F.col("member").isin(*flat), F.col("member")))).alias("flat"), *counts)
    rows = own.select(F.col("archive").alias("repo_id"), F.col("archive").alias("path"), "*")
    return ops.problems(rows, ("P29", F.col("tops") != 1, say("archive has ", F.col("tops"), " top-level packages")), *(("P29", F.col(f"n{i}") != n, say(f"expected {n} members below {k}, found ", F.col(f"n{i}"))) for i, (k, n) in enumerate(expected.items())), ("P29", F.size("flat") > 0, say("flat modules: ", F.array_join("flat", ", "))))
