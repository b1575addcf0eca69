"""Filter interaction audit: what each filter removes, at each step of each order, by a subset-zeta transform.

A document's mask holds a bit for each filter that it fails. The masks of a part (2 ** k counts at most) are all that the
audit needs: summed over subsets (the zeta transform, k passes over the 2 ** k counts) they give, for any set S of filters,
how many documents fail none of S. A step of an order goes from one set to a neighbour with one more filter, so what it
removes is a difference of two sums; the same with counts of labelled documents. A filter's removals over all k! orders are
these differences, each taken as often as orders pass through it.

The corpus is read once for the masks; documents are gathered nowhere, and equal texts (for the filter of copies) meet by
a grouped minimum and a lookup that withstands hot texts.

Cases: a null text is an empty one, which fails the filter of length and those of no share; documents with a null id copy
nothing and aren't labelled, but are the copies of no other either; rows of one id and one text are no copies of each
other; several labels of an id count as their greatest; a null part is the empty string; parts without a document don't
appear, so an empty table gives no row; a very long text is judged whole; further columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, utf8, written
from .components import hot_lookup

#: Filters in the order of their bits; the last one is that of copies.
LETTERS = "ABCDE"
#: Filters that are audited together at most: k * k! rows for each part.
MOST = 7
_CAPITALS, _SYMBOLS, _INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(128, 192))


def text_mask(raw: bytes) -> int:
    """Bits of the filters that a text fails by itself: A few words, B repeated words, C capitals, D symbols."""
    words, points = raw.split(), len(raw.translate(None, _INNER))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * points) << 2 | (len(raw.translate(None, _SYMBOLS)) < len(raw)) << 3


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part and mask of each row: the four filters of the text, and E for copies of a text with a smaller id."""

    def judge():
        def run(batch):
            raw = utf8(batch.column(1))
            found = [pa.array([text_mask(x) for x in raw], pa.int64()), pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary())]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *found], ["doc_id", "part", "mask", "digest"])

        return run

    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"))
    own = written(by_text(own, judge, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, part string, mask bigint, digest binary"), "masks")
    first = written(own.groupBy("digest").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "texts")
    met = hot_lookup(own, first, "digest", "n")
    copy = F.when(F.col("doc_id") > F.col("low"), 1 << LETTERS.index("E")).otherwise(0)
    return met.select("doc_id", "part", F.col("mask").bitwiseOR(copy.cast("bigint")).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic (0 or 1), by doc_id; those without a label or an id have 0."""
    own = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.coalesce((F.col(c) == 1).cast("bigint"), F.lit(0))).alias(new) for c, new in (("quality", "good"), ("toxic", "toxic"))))
    known = rows.where("doc_id IS NOT NULL").join(own, "doc_id", "left").fillna(0, ["good", "toxic"])
    return known.unionByName(rows.where("doc_id IS NULL").select("*", F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic")))


def _below(counts: Column, k: int) -> Column:
    """The zeta transform: for each set T, the sum of the counts of T's subsets."""
    bits = F.array(*(F.lit(1 << i) for i in range(k)))
    return F.aggregate(bits, counts, lambda sums, bit: F.transform(sums, lambda x, i: x + F.when(i.bitwiseAND(bit) > 0, F.get(sums, i.bitwiseXOR(bit))).otherwise(0)))


def audit(rows: DataFrame, measures: tuple[str, ...] = ("good", "toxic"), letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from rows of part, mask and measures (numbers that are added up).

    kept, removed, redundant, unique_fails and shapley count rows; <measure>_lost adds up a measure over the removed rows.
    Raises ValueError for over MOST filters.
    """
    k = len(letters)
    if not 1 <= k <= MOST:
        raise ValueError(f"one to {MOST} filters can be audited together, not {k}")
    full, sums = (1 << k) - 1, ("n", *measures)
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in measures))
    # 2 ** k masks of a part at most.
    table = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*sums)))).alias("by_mask"))

    def filled(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(full)), lambda i: F.coalesce(F.try_element_at("by_mask", i.cast("bigint"))[name], F.lit(0)).cast("bigint"))

    table = table.select("part", *(filled(c).alias(c) for c in sums))
    table = table.select("part", *(_below(F.col(c), k).alias(c) for c in sums))
    steps = [{"filter_order": "".join(letters[i] for i in order), "step": s + 1, "bit": 1 << order[s], "before": sum(1 << i for i in order[:s])} for order in permutations(range(k)) for s in range(k)]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, bit int, before int>>")

    def left(name: str, applied: Column) -> Column:
        """What fails none of the applied filters."""
        return F.get(F.col(name), F.lit(full).bitwiseXOR(applied))

    bit, before = F.col("s.bit"), F.col("s.before")
    removed = {c: left(c, before) - left(c, before.bitwiseOR(bit)) for c in sums}
    # So many orders have just a set of a given size before a filter.
    orders = F.array(*(F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)), F.lit(0))
    shapley = F.aggregate(
        F.sequence(F.lit(0), F.lit(full)), F.lit(0).cast("bigint"),
        lambda total, s: total + F.when(s.bitwiseAND(bit) == 0, F.get(orders, F.bit_count(s)) * (left("n", s) - left("n", s.bitwiseOR(bit)))).otherwise(0),
    )
    return table.select("*", F.explode(steps).alias("s")).select(
        "part", "s.filter_order", "s.step", left("n", before.bitwiseOR(bit)).alias("kept"), removed["n"].alias("removed"),
        (left("n", F.lit(0)) - left("n", bit) - removed["n"]).alias("redundant"), (F.get("n", bit) - F.get("n", F.lit(0))).alias("unique_fails"),
        *(removed[c].alias(f"{c}_lost") for c in measures), shapley.alias("shapley"),
    )


#: The same rows in DuckDB's SQL, counted for each order and step from the masks.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT x1.x || x2.x || x3.x || x4.x || x5.x AS filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] AS bs FROM x x1, x x2, x x3, x x4, x x5
  WHERE x1.b + x2.b + x3.b + x4.b + x5.b = 31 AND x1.b | x2.b | x3.b | x4.b | x5.b = 31),
s AS (SELECT filter_order, step, bs[step] AS bit, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS done FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (done | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & done = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & done > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & done = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & done = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
