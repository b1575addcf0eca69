"""From plans to records: plan items out of folders, checklists, issues and tracking files; ids; links; retirement.

Everything here derives rows; writing files is left to the caller (sinks.missing_files gives what isn't there yet).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as t
from recordloom.operators import dictionary
from recordloom.operators import relational as ops
from recordloom.sources.records import Records
from recordloom.sources.snapshot import text_lines

#: Where plans are looked for, what is no plan, lifecycles by folder name, and what they become.
PLAN_DIRS = ("todos", "todo", "plans", "tasks", "backlog")
CHECKLISTS = ("TODO.md", "ROADMAP.md", "BACKLOG.md")
SCAFFOLD = ("readme.md", "template.md", "index.md", "_index.md")
LIFECYCLES = ("proposed", "completed", "deferred", "blocked", "active")
BECOMES = {"completed": ("completed", "waived"), "proposed": ("proposed", "pending"), "deferred": ("deferred", "pending"), "blocked": ("blocked", "pending"), "active": ("active", "pending")}
TRACKING_DIRS = ("tracking",)
SEVERITY = {"p1": "high", "p2": "medium", "p3": "low", "high": "high", "medium": "medium", "low": "low"}
FINDING_STATE = {"open": "open", "accepted": "accepted", "reconciled": "reconciled", "closed": "reconciled", "resolved": "reconciled", "mitigated": "reconciled"}
TEXT_ENDS = ("md", "markdown", "txt", "rst", "py", "toml", "yaml", "yml", "json", "cfg", "ini", "sh", "ps1")

_ITEM = ["repo_id", "rank", "ord", "lifecycle", "slug", "title", "narrative", "source", "num"]


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def from_folders(r: Records, folders: tuple[str, ...] = PLAN_DIRS) -> DataFrame:
    """Items of plan folders: a folder or Markdown file each, active, or of the lifecycle of the folder above it."""
    tops = F.array(*map(F.lit, folders))
    entry = r.tree.withColumn("parts", F.split("path", "/")).withColumn("rank", F.array_position(tops, F.col("parts")[0])).where("rank > 0")
    entry = entry.where(~F.lower("name").isin(*SCAFFOLD) & ~F.col("name").isin(".git", ".venv", "node_modules", "__pycache__"))
    second = F.lower(F.try_element_at("parts", F.lit(2)))
    cycle = second.isin(*LIFECYCLES) & F.exists(F.array(*map(F.lit, LIFECYCLES)), lambda x: x == second)
    deep = F.size("parts")
    is_note = F.lower("name").endswith(".md")
    # Below a lifecycle folder, or beside those folders; a file that only bears such a name is no lifecycle folder.
    below = r.tree.where("is_dir").select("repo_id", F.col("path").alias("parent"), F.lit(True).alias("in_dir"))
    entry = entry.join(below, ["repo_id", "parent"], "left")
    entry = entry.where(F.col("is_dir") | is_note).where(((deep == 3) & cycle) | ((deep == 2) & ~(cycle & F.col("is_dir"))))
    lifecycle = F.when(deep == 3, second).otherwise(F.lit("active"))
    notes = r.files.where(F.lower("name").endswith(".md")).select("repo_id", F.col("parent").alias("path"), F.struct(F.when(F.col("name") == "README.md", 0).otherwise(1).alias("k"), F.col("name").alias("n")).alias("o"), F.col("text").alias("body")).where("body <> '' and (o.k = 0 or lower(o.n) <> 'readme.md')")
    first = notes.groupBy("repo_id", "path").agg(F.min_by("body", "o").alias("body"))
    own = entry.join(first, ["repo_id", "path"], "left").withColumn("narrative", F.when(F.col("is_dir"), F.coalesce("body", F.lit(""))).otherwise(F.coalesce("text", F.lit(""))))
    stem = F.when(F.col("is_dir"), F.col("name")).otherwise(F.regexp_replace("name", r"\.[^.]*\z", ""))
    num, slug = t.split_number(stem)
    own = own.withColumns({"lifecycle": lifecycle, "num": num, "slug": slug, "ord": F.col("path")})
    return own.withColumn("title", t.first_heading("narrative", F.initcap(F.replace("slug", F.lit("-"), F.lit(" "))))).withColumnRenamed("path", "source").select(*(F.col(c) for c in _ITEM))


def from_checklists(r: Records, names: tuple[str, ...] = CHECKLISTS) -> DataFrame:
    """Items of checklists: boxes by their state, plain bullets by their section's heading, which carries on."""
    at = F.array_position(F.array(*map(F.lit, names)), F.col("path"))
    own = text_lines(r.files.where(F.col("path").isin(*names)))
    heading = F.regexp_extract("line", r"^#{1,3}\s+(.+?)\s*$", 1)
    own = ops.carry_forward(own, ["repo_id", "path"], ["pos"], heading != "", t.section_lifecycle(heading), "section").where(heading == "")
    box, boxed = r"^[-*]\s+\[([ xX])\]\s+(.+?)\s*$", F.col("line").rlike(r"^[-*]\s+\[[ xX]\]\s+.+?\s*$")
    plain = F.regexp_extract("line", r"^[-*]\s+(.+?)\s*$", 1)
    own = own.where(boxed | ((plain != "") & F.col("section").isNotNull()))
    title = t.clean_inline(F.when(boxed, F.regexp_extract("line", box, 2)).otherwise(plain))
    lifecycle = F.when(boxed & (F.lower(F.regexp_extract("line", box, 1)) == "x"), "completed").otherwise(F.when(boxed, F.coalesce("section", F.lit("active"))).otherwise(F.col("section")))
    own = own.select("repo_id", (at + 100).alias("rank"), F.format_string("%09d", "pos").alias("ord"), lifecycle.alias("lifecycle"), t.slug(title, 60).alias("slug"), title.alias("title"), F.concat(F.trim("line"), F.lit("\n")).alias("narrative"), F.col("path").alias("source"), F.lit(None).cast("string").alias("num"))
    return own


def from_issues(issues: DataFrame, limit: int = 200) -> DataFrame:
    """Items of issues (repo_id, number, title, body, state, url): open ones active, closed ones completed; `limit` newest."""
    from pyspark.sql.window import Window

    own = issues.withColumn("_n", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("number")))).where(F.col("_n") <= limit)
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("issue-"), F.col("number").cast("string")))
    return own.select("repo_id", F.lit(1000).alias("rank"), F.format_string("%09d", "_n").alias("ord"), F.when(F.upper("state") == "CLOSED", "completed").otherwise("active").alias("lifecycle"), t.slug(title, 60, "issue").alias("slug"), title.alias("title"), F.concat(F.coalesce("url", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("narrative"), F.concat(F.lit("github:#"), F.col("number").cast("string")).alias("source"), F.lit(None).cast("string").alias("num"))


def discover(r: Records, issues: DataFrame | None = None) -> DataFrame:
    """All plan items, in the order rank, ord."""
    frames = [from_folders(r), from_checklists(r), *([from_issues(issues)] if issues is not None else [])]
    return ops.union_all([f.select(*(F.col(c).cast("int") if c == "rank" else F.col(c) for c in _ITEM)) for f in frames])


def used_work(r: Records) -> DataFrame:
    """repo_id, id and slug of all manifests."""
    return r.work.select("repo_id", "id", F.regexp_replace("dir_name", r"^\d+-", "").alias("slug"))


def allocate(items: DataFrame, used: DataFrame) -> DataFrame:
    """items with item_id: the preferred number where it is free, else the first free one from 200, in their order.

    A number that one item falls back to may be what a later one prefers, so a repository's items are gone through in
    order by one task; they are the plans of one repository.
    """
    schema = ", ".join(f"{n} {k}" for n, k in items.dtypes)

    def place(key, rows: pd.DataFrame, taken: pd.DataFrame) -> pd.DataFrame:
        ids, out, low = set(taken["id"]), [], 200
        rows = rows.sort_values(["rank", "ord"], ignore_index=True)
        for num in rows["num"]:
            own = num.zfill(3) if isinstance(num, str) and num.strip("0") else None
            if own is None or own in ids:
                while f"{low:03d}" in ids:
                    low += 1
                own = f"{low:03d}"
            ids.add(own)
            out.append(own)
        return rows.assign(item_id=out)

    taken = used.select(F.col("repo_id").alias("_repo"), "id")  # by another name, for both sides may stem from one table
    return items.groupBy("repo_id").cogroup(taken.groupBy("_repo")).applyInPandas(place, f"{schema}, item_id string")


def planned(r: Records, issues: DataFrame | None = None) -> DataFrame:
    """Items whose slug is new, each slug once (the first counts), with item_id, status, criterion_state and home."""
    used = used_work(r)
    items = discover(r, issues)
    fresh = ops.first_by(items, ["repo_id", "slug"], F.struct("rank", "ord"), [c for c in _ITEM if c not in ("repo_id", "slug")]).select(*_ITEM)
    own = allocate(fresh.join(used.select("repo_id", "slug").distinct(), ["repo_id", "slug"], "left_anti").select(*_ITEM), used)
    status = F.element_at(_map({k: v[0] for k, v in BECOMES.items()}), F.col("lifecycle"))
    return own.withColumns({"status": status, "criterion_state": F.element_at(_map({k: v[1] for k, v in BECOMES.items()}), F.col("lifecycle"))}).withColumn("home", F.concat(F.lit("work/"), "status", F.lit("/"), "item_id", F.lit("-"), "slug"))


LINK = r"\]\(([^)\s]+)\)"


def rebased(items: DataFrame) -> DataFrame:
    """items with `narrative` whose relative links hold from `home`; links into other items go to their README.

    Links are cut out, looked up by the folders above their targets, and put back in their places. URLs, anchors,
    absolute paths and mail links stay as they are.
    """
    parts = F.split("narrative", r"(?<=\]\()|(?=\))")
    own = items.withColumn("_row", F.concat_ws("\0", "repo_id", "home"))
    each = own.select("repo_id", "_row", "source", "home", F.posexplode(parts).alias("pos", "part"), F.size(parts).alias("n"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("_row").orderBy("pos")
    each = each.withColumns({"before": F.lag("part", 1, "").over(w), "after": F.lead("part", 1, "").over(w)})
    target = F.split_part("part", F.lit("#"), F.lit(1))
    kept = F.col("part").rlike(r"^(#|/|<|mailto:)|://|\s") | (target == "")
    is_link = F.col("before").endswith("](") & F.startswith("after", F.lit(")")) & ~kept
    base = F.when(F.col("source").endswith(".md"), t.parent("source")).otherwise(F.col("source"))
    each = each.withColumn("old", F.when(is_link, t.normal_path(F.concat(base, F.lit("/"), target))))
    homes = items.select("repo_id", F.col("source").alias("prefix"), F.col("home").alias("to"))
    each = ops.most_specific(each, homes, "old", "prefix", "to", ["repo_id"])
    new = t.relative_path(F.when(F.col("to").isNotNull(), F.concat("to", F.lit("/README.md"))).otherwise(F.col("old")), F.col("home"))
    new = F.when(target.endswith("/") & F.col("to").isNull() & ~new.endswith("/"), F.concat(new, F.lit("/"))).otherwise(new)
    anchor = F.when(F.contains("part", F.lit("#")), F.regexp_extract("part", "#.*$", 0)).otherwise(F.lit(""))
    each = each.withColumn("part", F.when(F.col("old").isNotNull(), F.concat(new, anchor)).otherwise(F.col("part")))
    text = each.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("_text"))
    return own.join(text, "_row").withColumn("narrative", F.col("_text")).drop("_row", "_text")


def blocks(files: DataFrame, id_pattern: str) -> DataFrame:
    """repo_id, path, id, title, body and pos of `## <ID>: title` blocks, each up to the next such heading."""
    start = rf"(?m)^##\s+({id_pattern})\s*:?[ \t]*(.*?)[ \t]*$"
    parts = F.filter(F.split("text", rf"(?m)(?=^##\s+(?:{id_pattern}))"), lambda x: x.rlike(rf"^##\s+(?:{id_pattern})"))
    own = files.select("repo_id", "path", F.posexplode(parts).alias("pos", "body"))
    return own.select("repo_id", "path", "pos", F.regexp_extract("body", start, 1).alias("id"), F.trim(F.regexp_extract("body", start, 2)).alias("title"), "body")


def field(body: Column | str, name: str) -> Column:
    found = F.regexp_extract(body, rf"(?im)^\s*{name}\s*:[ \t]*(\S.*?)\s*$", 1)
    return F.nullif(F.regexp_replace(found, "^`+|`+$", ""), F.lit(""))


def ranked_free(wanted: DataFrame, used: DataFrame, first: int, width: int) -> DataFrame:
    """wanted (repo_id, ord, ...) with `number`: for each repository its free numbers from `first`, in order of ord.

    The k-th row gets the k-th gap: of first .. first + all used and wanted, those that the anti-join leaves.
    """
    from pyspark.sql.window import Window

    ranked = wanted.withColumn("_k", F.row_number().over(Window.partitionBy("repo_id").orderBy("ord")))
    taken = used.select("repo_id", F.col("id").try_cast("bigint").alias("n")).where(F.col("n") >= first).distinct()
    need = ranked.groupBy("repo_id").agg(F.count("*").alias("want")).join(taken.groupBy("repo_id").agg(F.count("*").alias("have")), "repo_id", "left")
    span = need.select("repo_id", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(first) + F.col("want") + F.coalesce("have", F.lit(0)))).alias("n"))
    free = span.join(taken, ["repo_id", "n"], "left_anti").withColumn("_k", F.row_number().over(Window.partitionBy("repo_id").orderBy("n")))
    return ranked.join(free, ["repo_id", "_k"]).withColumn("number", F.lpad(F.col("n").cast("string"), F.greatest(F.lit(width), F.length(F.col("n").cast("string"))), F.lit("0"))).drop("_k", "n")


def tracked_decisions(r: Records, as_of: str, folder: str = TRACKING_DIRS[0]) -> DataFrame:
    """Decision records of tracking blocks that no decision carries a mark of yet."""
    from recordloom.model import DECISION_STATUSES

    own = blocks(r.one(f"{folder}/decisions.md"), r"DEC-\d+").withColumn("mark", F.concat(F.lit(f"<!-- source: {folder}/decisions.md#"), "id", F.lit(" -->")))
    seen = r.decisions.select("repo_id", F.explode(F.regexp_extract_all("text", F.lit("<!-- source: [^>]*? -->"), F.lit(0))).alias("mark")).distinct()
    fresh = own.join(seen, ["repo_id", "mark"], "left_anti").withColumn("ord", F.col("pos"))
    used = r.decisions.select("repo_id", F.regexp_extract("name", r"^(\d{4,})-", 1).alias("id"))
    state, day = F.lower(field("body", "Status")), field("body", "Date")
    out = ranked_free(fresh, used, 1, 4).withColumns({"status": F.when(F.coalesce(state.isin(*DECISION_STATUSES), F.lit(False)), state).otherwise(F.lit("accepted")), "date": F.when(t.is_date(F.coalesce(day, F.lit(""))), day).otherwise(F.lit(as_of))})
    return out.select("repo_id", F.col("number").alias("decision_id"), F.coalesce(F.nullif("title", F.lit("")), "id").alias("title"), "status", "date", "mark", F.concat(F.lit("decisions/"), "number", F.lit("-"), t.slug("title", 50), F.lit(".md")).alias("path"), F.trim("body").alias("body"))


def tracked_risks(r: Records, as_of: str, folder: str = TRACKING_DIRS[0]) -> DataFrame:
    """Findings of risk table rows that no finding names as its source yet."""
    own = text_lines(r.one(f"{folder}/risks.md")).withColumn("id", F.regexp_extract("line", r"^\s*\|\s*(RISK-\d+)\s*\|.+$", 1)).where("id <> ''")
    cells = F.transform(F.split(F.regexp_extract("line", r"^\s*\|\s*RISK-\d+\s*\|(.+)$", 1), r"\|"), lambda x: F.trim(x))
    own = own.withColumns({"cells": cells, "source": F.concat(F.lit(f"{folder}/risks.md#"), "id"), "ord": F.col("pos")})
    fresh = own.join(r.findings.select("repo_id", F.col("data.source").alias("source")), ["repo_id", "source"], "left_anti")
    cell = lambda i: F.coalesce(F.try_element_at("cells", F.lit(i)), F.lit(""))
    used = r.findings.select("repo_id", F.regexp_extract("name", r"^(\d{3,})-", 1).alias("id"))
    out = ranked_free(fresh, used, 1, 3)
    look = lambda table, key, default: F.coalesce(F.try_element_at(_map(table), F.lower(key)), F.lit(default))
    fix = F.when(F.size("cells") > 4, cell(5)).otherwise(F.element_at("cells", -1))
    return out.select("repo_id", F.col("number").alias("finding_id"), F.concat(F.lit("["), "id", F.lit("] "), cell(1)).alias("observed"), look(SEVERITY, cell(2), "medium").alias("risk"), look(FINDING_STATE, cell(3), "open").alias("state"), F.coalesce(F.nullif(fix, F.lit("")), F.lit("See source risk register.")).alias("reconciliation"), F.lit(as_of).alias("created"), "source", F.concat(F.lit("audits/findings/"), "number", F.lit("-"), t.slug(cell(1), 40, "risk"), F.lit(".json")).alias("path"))


def tracked_milestones(r: Records, folder: str = TRACKING_DIRS[0]) -> DataFrame:
    """Work items of milestones whose slug is new; shipped ones are completed, their criterion waived."""
    own = blocks(r.one(f"{folder}/milestones.md"), r"M\d+")
    own = own.withColumns({"slug": t.slug(F.concat(F.lit("milestone-"), F.coalesce(F.nullif("title", F.lit("")), "id")), 55), "ord": F.col("pos")})
    fresh = ops.first_by(own, ["repo_id", "slug"], "ord", ["id", "title", "body", "ord"]).join(used_work(r).select("repo_id", "slug"), ["repo_id", "slug"], "left_anti")
    said = F.lower(F.coalesce(field("body", "Status"), F.lit("")))
    done = F.exists(F.array(*map(F.lit, ("shipped", "done", "complete", "delivered"))), lambda x: F.contains(said, x))
    out = ranked_free(fresh.withColumn("done", done), used_work(r), 300, 3)
    status = F.when(F.col("done"), "completed").otherwise("active")
    return out.select("repo_id", F.col("number").alias("item_id"), "slug", F.when(F.col("title") != "", F.concat("id", F.lit(": "), "title")).otherwise(F.col("id")).alias("title"), status.alias("status"), F.when(F.col("done"), "waived").otherwise("pending").alias("criterion_state"), F.concat(F.lit(f"{folder}/milestones.md#"), "id").alias("source"))


# --- retirement of plan folders ---


def migrated(r: Records, folders: tuple[str, ...] = PLAN_DIRS) -> DataFrame:
    """repo_id, folder, source and migrated: whether a work item names the plan item as its source."""
    known = r.work.where("data.source is not null").select("repo_id", F.translate("data.source", "\\", "/").alias("source"), F.lit(True).alias("_m")).distinct()
    items = from_folders(r, folders).select("repo_id", F.split_part("source", F.lit("/"), F.lit(1)).alias("folder"), "source")
    return items.join(known, ["repo_id", "source"], "left").select("repo_id", "folder", "source", F.col("_m").isNotNull().alias("migrated"))


def scopes_inside(r: Records, folders: DataFrame) -> DataFrame:
    """Audit scopes and contracts (repo_id, folder, value) that lie in folders (repo_id, folder)."""
    values = r.audit_scopes.select("repo_id", F.explode(F.array(F.translate("scope", "\\", "/"), F.translate("contract", "\\", "/"))).alias("value")).where("value <> ''").distinct()
    return values.join(folders, "repo_id").where((F.col("value") == F.col("folder")) | F.startswith("value", F.concat("folder", F.lit("/"))))


def retirement(r: Records, git: DataFrame, folders: tuple[str, ...] = PLAN_DIRS) -> DataFrame:
    """repo_id, folder, action and reason: block, delete (git can bring it back) or archive.

    git: (repo_id, folder, tracked, clean, head) tells what version control knows of each folder.
    """
    state = migrated(r, folders).groupBy("repo_id", "folder").agg(F.count_if(~F.col("migrated")).alias("left"), F.count("*").alias("n"))
    inside = scopes_inside(r, state.select("repo_id", "folder")).groupBy("repo_id", "folder").agg(F.sort_array(F.collect_set("value")).alias("scopes"))
    own = state.join(inside, ["repo_id", "folder"], "left").join(git, ["repo_id", "folder"], "left")
    why = F.when(F.col("left") > 0, F.concat(F.col("left").cast("string"), F.lit(" unmigrated items"))).when(F.col("scopes").isNotNull(), F.concat(F.lit("audit scopes inside: "), F.array_join("scopes", ", ")))
    lost = F.when(~F.coalesce("tracked", F.lit(False)), "not tracked").when(~F.coalesce("clean", F.lit(False)), "uncommitted or ignored files").when(F.col("head").isNull(), "no commit")
    return own.select("repo_id", "folder", F.when(why.isNotNull(), "block").when(lost.isNull(), "delete").otherwise("archive").alias("action"), F.coalesce(why, lost).alias("reason"))


def _and_above(path: str) -> Column:
    """A path and the folders above it."""
    parts = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def references(r: Records, retired: DataFrame) -> DataFrame:
    """Lines elsewhere that name something below retired folders (repo_id, folder): with `token`, `mapped` and `kind`.

    kind: link for Markdown links and pointer for source_of_truth lines, which may be rewritten where mapped isn't
    null; mention for all others. A token's head is swapped for the work item of that name, its lead of `../` stays.
    """
    own = r.files.where(F.lower(F.regexp_extract("name", r"\.([^.]+)\z", 1)).isin(*TEXT_ENDS) & ~F.col("path").rlike(r"^(\.git|node_modules|archive)/|/__pycache__/"))
    retired = retired.select("repo_id", "folder").where("folder <> ''").distinct()
    hits = dictionary.occurrences(text_lines(own).where(~F.contains("line", F.lit("Imported from"))), retired.select(F.concat("folder", F.lit("/")).alias("name")), "line")
    # Names of all repositories are sought at once; those of a line's own count, and only outside of retired folders.
    hits = hits.withColumn("folder", F.expr("left(name, length(name) - 1)")).join(retired, ["repo_id", "folder"])
    inside = hits.select("repo_id", "path").distinct().select("repo_id", "path", F.explode(_and_above("path")).alias("folder")).join(retired, ["repo_id", "folder"]).select("repo_id", "path").distinct()
    hits = hits.join(inside, ["repo_id", "path"], "left_anti")
    before, after = F.expr("left(line, at)"), F.expr("substring(line, stop + 1)")
    hits = hits.withColumns({"lead": F.regexp_extract(before, r"((?:\.\./)*)\z", 1), "rest": F.regexp_extract(after, r"^[^\s;)\"'`]+", 0)}).where("rest <> ''")
    hits = hits.select("repo_id", "path", "pos", "line", (F.col("at") - F.length("lead")).alias("start"), "stop", (F.col("stop") + F.length("rest")).alias("last"), F.concat("lead", "name", "rest").alias("token"))
    tokens = dictionary.leftmost(hits, ["repo_id", "path", "pos", "line"], "start", "last", "token").withColumn("token", F.explode("token"))
    lead = F.regexp_extract("token", r"^((?:\.\./)*)", 1)
    parts = F.filter(F.split(F.expr("substring(token, length(regexp_extract(token, '^((?:\\\\.\\\\./)*)', 1)) + 1)"), "/"), lambda x: x != "")
    skip = F.when(F.coalesce(F.try_element_at(parts, F.lit(2)).isin(*LIFECYCLES), F.lit(False)), 2).otherwise(1)
    tokens = tokens.withColumns({"lead": lead, "dir_name": F.try_element_at(parts, skip + 1), "sub": F.array_join(F.slice(parts, skip + 2, F.greatest(F.size(parts), F.lit(1))), "/"), "slash": F.when(F.col("token").endswith("/"), "/").otherwise(F.lit(""))})
    home = r.work.select("repo_id", "dir_name", F.col("parent").alias("home"))
    tokens = tokens.join(home, ["repo_id", "dir_name"], "left").withColumn("deep", F.concat("home", F.lit("/"), "sub"))
    tokens = tokens.join(r.tree.select("repo_id", F.col("path").alias("deep"), F.lit(True).alias("there")), ["repo_id", "deep"], "left")
    to = F.when(F.col("dir_name").isNull(), F.concat("lead", F.lit("work"), "slash")).when(F.col("home").isNull(), None).when(F.col("sub") == "", F.concat("lead", "home", "slash")).when(F.col("there"), F.concat("lead", "deep")).otherwise(F.concat("lead", "home", F.lit("/README.md")))
    kind = F.when(F.contains("line", F.concat(F.lit("]("), "token", F.lit(")"))), "link").when(F.ltrim("line").startswith("source_of_truth:"), "pointer").otherwise("mention")
    return tokens.select("repo_id", "path", "pos", "line", "token", to.alias("mapped"), kind.alias("kind"))


def rewritten(refs: DataFrame) -> DataFrame:
    """repo_id, path, pos and line with links and pointers swapped for what they map to; longer tokens first."""
    own = refs.where("mapped is not null and kind in ('link', 'pointer')")
    each = own.groupBy("repo_id", "path", "pos", "line").agg(F.array_sort(F.collect_list(F.struct((-F.length("token")).alias("n"), "token", "mapped"))).alias("swaps"))
    swapped = F.aggregate("swaps", F.col("line"), lambda acc, s: F.replace(acc, s["token"], s["mapped"]))
    return each.select("repo_id", "path", "pos", swapped.alias("line"))


def unresolved(refs: DataFrame) -> DataFrame:
    """repo_id and report (`file:line: token`) of what remains after the rewriting."""
    return refs.where("mapped is null or kind = 'mention'").select("repo_id", F.concat("path", F.lit(":"), F.col("pos").cast("string"), F.lit(": "), "token").alias("report"))
