"""Relational operators that the record rules and the table queries share.

Each takes and returns DataFrames and only declares a plan: nothing is collected, every choice of join is Spark's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import text as t

#: Rows of the result relation of all rules.
PROBLEM = "repo_id string, path string, message string, rule_id string, subject string"


def dangling(refs: DataFrame, targets: DataFrame, on: Sequence[str]) -> DataFrame:
    """References without a target; a null reference dangles as well."""
    return refs.join(targets.select(*on).distinct(), list(on), "left_anti")


#: Rows of a task whose memory grows with its rows, about, and partitions up to which a task that writes a shuffle needs
#: no memory for it; beyond these it sorts all rows of its split.
TASK_ROWS, UNSORTED = 1 << 19, 200


def tasks_for(rows: DataFrame) -> int:
    """As many tasks as hold TASK_ROWS each, UNSORTED at most; the rows are counted for it."""
    context = rows.sparkSession.sparkContext
    return max(context.defaultParallelism, min(UNSORTED, -(-rows.count() // TASK_ROWS)))


def counted(rows: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """How often each key occurs; partial counts come before the shuffle by keys, so a frequent key is few rows there.

    Where most keys are rare, partial counts of all that a task reads are as many as its rows, and its memory grows with the
    split. So the rows are dealt first, whatever their keys, and neither step holds many more than TASK_ROWS.
    """
    n = tasks_for(rows)
    # Eight to a task, since two may meet in one.
    dealt = rows.select(*keys, F.pmod(F.monotonically_increasing_id(), F.lit(8 * n)).alias("_part")).repartition(n, "_part")
    parts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).drop("_part")
    return parts.repartition(n, *keys).groupBy(*keys).agg(F.sum("_n").alias(count))


def duplicates(rows: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Keys that occur more than once, and how often."""
    return counted(rows, keys, count).where(F.col(count) > 1)


def later_occurrences(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, previous: bool = False) -> DataFrame:
    """The second and later rows of a key, with `other`: the first one's value, or with previous the one's before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    other = F.lag(value).over(w) if previous else F.first(value).over(w)
    return rows.withColumn("_n", F.row_number().over(w)).withColumn("other", other).where("_n > 1").drop("_n")


def first_and_last_by(rows: DataFrame, keys: Sequence[str], order: Column | str, value: str, first: str, last: str) -> DataFrame:
    """One row for each key, with the value of its smallest order and that of its largest, in one pass."""
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(first), F.max_by(value, order).alias(last))


def first_by(rows: DataFrame, keys: Sequence[str], order: Column | str, values: Sequence[str]) -> DataFrame:
    """One row for each key, that of the smallest order; an aggregate, so a hot key is met by partial minima."""
    return rows.groupBy(*keys).agg(*(F.min_by(v, order).alias(v) for v in values))


def last_by(rows: DataFrame, keys: Sequence[str], order: Column | str, values: Sequence[str]) -> DataFrame:
    """One row for each key, that of the largest order."""
    return rows.groupBy(*keys).agg(*(F.max_by(v, order).alias(v) for v in values))


def zero_filled(rows: DataFrame, dimension: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """A count for every row of the dimension, 0 where there is none."""
    return dimension.join(rows.groupBy(*keys).agg(F.count("*").alias(count)), list(keys), "left").withColumn(count, F.coalesce(count, F.lit(0).cast("bigint")))


def coverage(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of either side and `side`: both, left or right."""
    a = left.select(*on).distinct().withColumn("_l", F.lit(True))
    b = right.select(*on).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_l").isNotNull(), "left").otherwise("right")
    return a.join(b, list(on), "full_outer").select(*on, side.alias("side"))


def carry_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, value: Column, name: str) -> DataFrame:
    """The value of the last row at or before each row where `starts` holds; a null value there is carried as null."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(starts, F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"])


#: Members of one value that a task holds against as many others.
BLOCK = 1024


def overlaps(members: DataFrame, scope: Sequence[str], item: str, value: str, order: str) -> DataFrame:
    """Pairs of items (left before right by order) that share values, and the values sorted; an item has one order.

    An equi self-join on scope and value: its work is that of the pairs it finds, not of all pairs. Members carry all their
    values, so a pair is told once, at the least value that it shares, and isn't shuffled again. A value of many members is
    dealt to blocks, each pair of which is a key of its own.
    """
    own = members.where(F.col(value).isNotNull()).groupBy(*scope, item, order).agg(F.sort_array(F.collect_set(value)).alias("_own")).withColumn(value, F.explode("_own"))
    many = own.groupBy(*scope, value).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")).where("_blocks > 1")
    own = own.join(many, [*scope, value], "left").withColumns({"_blocks": F.coalesce("_blocks", F.lit(1)), "_at": F.pmod(F.xxhash64(item, order), F.coalesce("_blocks", F.lit(1)))})
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - F.lit(1).cast("bigint")))
    a = own.select(*scope, value, F.col("_at").alias("_a"), other.alias("_b"), F.col(item).alias("left"), F.col(order).alias("_lo"), F.col("_own").alias("_l"))
    b = own.select(*scope, value, other.alias("_a"), F.col("_at").alias("_b"), F.col(item).alias("right"), F.col(order).alias("_ro"), F.col("_own").alias("_r"))
    keys = [*scope, value, "_a", "_b"]
    # The pairs are far more than the rows, by whose size tasks would be made few.
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = a.repartition(n, *keys).join(b.repartition(n, *keys), keys).where("_lo < _ro").withColumn("shared", F.array_intersect("_l", "_r"))
    return both.where(F.col("shared")[0] == F.col(value)).select(*scope, "left", "right", "shared")


#: Rows up to which Spark may send a table to all tasks at once. It goes by the bytes of a shuffle, which are compressed;
#: held by the driver, some megabytes of globs and their patterns are hundreds.
FEW_ROWS = 1 << 14


def sorted_if_many(table: DataFrame) -> DataFrame:
    """table, for a join that no broadcast of it must serve where it has over FEW_ROWS rows; they are counted for it."""
    return table.hint("merge") if table.limit(FEW_ROWS + 1).count() > FEW_ROWS else table


def pattern_hits(paths: DataFrame, patterns: DataFrame, path: str, scope: Sequence[str] = ()) -> DataFrame:
    """paths with the columns of each pattern that matches: patterns have a glob, whose `*` also crosses `/`, and further columns."""
    return glob_hits(paths, patterns, path, scope).join(sorted_if_many(patterns), [*scope, "glob"]).drop("glob")


def glob_hits(paths: DataFrame, patterns: DataFrame, path: str, scope: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    """paths with each distinct glob of their scope that matches, and its values: columns of patterns that have one row for a glob.

    The index of globs holds them by a key that a matching path must have (functions.text.glob_keys): a literal folder and
    an ending, or a whole word. Of its keys a glob is filed under the one that it shares with the fewest others, so a path
    meets few of them, by equality; only those that have its literal parts are matched as a whole.
    """
    globs = patterns.select(*scope, "glob", *values).where("glob IS NOT NULL")
    globs = globs if values else globs.distinct()
    many = globs.limit(FEW_ROWS + 1).count() > FEW_ROWS
    held = (lambda table: table.hint("merge")) if many else (lambda table: table)
    each = globs.withColumn("_key", F.explode(t.glob_keys("glob")))
    shared = each.groupBy(*scope, "_key").agg(F.count("*").alias("_n"))
    # Of equally rare keys that of a folder (`/`) comes before a word (`w`).
    filed = each.join(held(shared), [*scope, "_key"]).groupBy(*scope, "glob").agg(F.min(F.struct("_n", "_key"))["_key"].alias("_key"), *(F.first(c).alias(c) for c in values))
    regex, head = t.glob_pattern("glob")
    filed = filed.withColumns({"_regex": regex, "_head": head, "_mid": t.glob_middle("glob")})
    keyed = paths.withColumn("_key", F.explode(t.path_keys(F.col(path))))
    if many:
        # Keys go by their hashes, of which a path has each once: what matches is told by the glob as a whole.
        keyed = paths.withColumn("_key", F.explode(F.array_distinct(F.transform(t.path_keys(F.col(path)), lambda x: F.xxhash64(x)))))
        filed = filed.withColumn("_key", F.xxhash64("_key"))
        # What is matched is far more than the rows, by whose size tasks would be made few.
        n, keys = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*scope, "_key"]
        keyed, filed = keyed.repartition(n, *keys), filed.repartition(n, *keys)
    near = keyed.join(held(filed), [*scope, "_key"]).where(F.expr(f"startswith(`{path}`, _head) AND contains(`{path}`, _mid) AND `{path}` rlike _regex"))
    return near.select(*paths.columns, "glob", *values)


def owners(paths: DataFrame, patterns: DataFrame, path: str, scope: Sequence[str] = ()) -> DataFrame:
    """Distinct paths with `owners`: the sorted ids of the patterns (id, glob) of their scope that match; none gives an empty list."""
    ids = patterns.groupBy(*scope, "glob").agg(F.collect_set("id").alias("_ids"))
    hits = glob_hits(paths, ids, path, scope, ["_ids"]).select(*paths.columns, "_ids")
    whole = paths.withColumn("_ids", F.lit(None).cast(ids.schema["_ids"].dataType)).unionByName(hits)
    return whole.groupBy(*paths.columns).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_ids")))).alias("owners"))


def owners_of(path: Column, patterns: Sequence[tuple[str, str, str]]) -> Column:
    """The sorted ids of a few fixed patterns (id, regex, head) that match: a projection, each pattern compiled once."""
    own = F.array_compact(F.array(*(F.when(F.startswith(path, F.lit(head)) & path.rlike(regex), F.lit(i)) for i, regex, head in patterns)))
    return F.sort_array(F.array_distinct(own))


def most_specific(rows: DataFrame, prefixes: DataFrame, text: str, prefix: str, value: str, scope: Sequence[str] = ()) -> DataFrame:
    """rows with `value` of the longest prefix that is the text or a folder above it, null if there is none.

    A path has few folders above it: each is looked up by equality, so no theta join is needed.
    """
    parts = F.split(F.col(text), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    texts = rows.select(*scope, text).where(F.col(text).isNotNull()).distinct()
    hits = texts.select(*scope, text, F.explode(above).alias(prefix)).join(prefixes.select(*scope, prefix, value), [*scope, prefix])
    best = hits.groupBy(*scope, text).agg(F.max_by(value, F.length(prefix)).alias(value))
    return rows.join(best, [*scope, text], "left")


def missing_values(used: DataFrame, column: str, first: int, want: int) -> DataFrame:
    """The `want` smallest numbers from `first` on that aren't used, with rank from 1.

    Among first .. first + want + used - 1 there are always enough; they are counted first, so that the range is dealt
    over tasks, and the gaps are found by an anti-join.
    """
    own = used.select(F.col(column).cast("bigint").alias("value")).where(F.col("value") >= first).distinct()
    span = used.sparkSession.range(first, first + want + own.count()).select(F.col("id").alias("value"))
    free = span.join(own, "value", "left_anti").orderBy("value").limit(want)
    return free.select("value", F.row_number().over(Window.orderBy("value")).alias("rank"))  # `want` rows


def next_id(used: DataFrame, column: str, width: int, start: int = 0) -> DataFrame:
    """The largest number + 1 as text of at least `width` digits; `start` where there is none."""
    n = F.coalesce(F.max(F.col(column).try_cast("bigint")) + 1, F.lit(start).cast("bigint")).cast("string")
    return used.agg(n.alias("n")).select(F.lpad("n", F.greatest(F.lit(width), F.length("n")), F.lit("0")).alias("next_id"))


def problems(rows: DataFrame, *checks: tuple[str, Column, Column | str], path: str = "path", subject: str | None = None) -> DataFrame:
    """All problems of row-local checks (rule, condition, message) in one pass over the rows."""
    found = [F.when(condition, F.struct(F.lit(rule).alias("rule_id"), (F.lit(m) if isinstance(m, str) else m).alias("message"))) for rule, condition, m in checks]
    out = rows.withColumn("_p", F.explode(F.array_compact(F.array(*found))))
    return out.select("repo_id", F.col(path).alias("path"), F.col("_p.message").alias("message"), F.col("_p.rule_id").alias("rule_id"), (F.col(subject).cast("string") if subject else F.lit(None).cast("string")).alias("subject"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by name: problems found twice stay twice."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
