"""Occurrences of many given texts in many others: Aho-Corasick automata, one pass over each text for all that are sought."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

#: Characters that one automaton holds, at most (some 60 MB in a worker); more are dealt to several.
MOST = 1 << 20
#: Last characters of a name, by which names are dealt to automata, and texts to those whose names may end in them.
GRAM = 4


def occurrences(rows: DataFrame, names: DataFrame, text: str, most: int = MOST) -> DataFrame:
    """rows with name, at (from 0) and stop of each place where a name (names: name) stands in the text; overlaps are all told.

    The names are the broadcast side: their characters are counted first, and over `most` of them are dealt to automata of
    about that size by their last characters, so that what a worker holds doesn't grow with them. A text then goes to one
    automaton for each of the names' endings that it has, not to all: more names give no more passes over the texts. Only
    names shorter than an ending are sought in every text. Rows without a name in them give no row; null and empty texts and
    names none.
    """
    own = names.select("name").where("name <> ''").distinct()
    chars = lambda x: x.agg(F.sum(F.length("name"))).first()[0] or 0
    if chars(own) <= most:
        return _found(rows.withColumns({"_gram": F.lit(""), "_part": F.lit(0)}), own.withColumn("_part", F.lit(0)), text)
    short, own = own.where(F.length("name") < GRAM), own.where(F.length("name") >= GRAM)
    parts, passes = max(1, -(-chars(own) // most)), -(-chars(short) // most)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    gram = own.select("name", F.right("name", F.lit(GRAM)).alias("_gram"))
    ends = [r[0] for r in own.select(F.right("name", F.lit(1))).distinct().limit(17).collect()]
    last = f"[{''.join(map(re.escape, ends))}]" if 0 < len(ends) < 17 else "."
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM - 1}}}{last}))"), F.lit(1)))
    dealt = rows.withColumn("_gram", F.explode(grams)).join(gram.select("_gram").distinct(), "_gram").withColumn("_part", part("_gram", parts))
    # A task has few parts, one behind the other, for each of which it makes the automaton once.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "_part", F.pmod(F.xxhash64(text), F.lit(max(1, tasks // parts)))).sortWithinPartitions("_part")
    found = _found(dealt.select(*rows.columns, "_gram", "_part"), gram.select("name", part("_gram", parts).alias("_part")), text)
    for k in range(passes):
        found = found.unionByName(_found(rows.withColumns({"_gram": F.lit(""), "_part": F.lit(0)}), short.where(part("name", passes) == k).withColumn("_part", F.lit(0)), text))
    return found


def _found(rows: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """rows (_gram, _part besides) with the names (name, _part) of their part in the text that end in their gram."""
    columns = [c for c in rows.columns if c not in ("_gram", "_part")]
    out = StructType(list(rows.select(*columns).schema)).add("name", StringType()).add("at", LongType()).add("stop", LongType())
    arrow = to_arrow_schema(out)
    parts = [r[0] for r in names.select("_part").distinct().collect()]
    sought = {k: rows.sparkSession.sparkContext.broadcast(sorted(r[0] for r in names.where(F.col("_part") == k).collect())) for k in parts}  # about MOST characters each

    def run(batches):
        now, automaton = None, None
        for batch in batches:
            place, found = [], []
            own = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text, "_gram", "_part"))
            for i, (x, gram, part) in enumerate(zip(*own, strict=True)):
                if part != now:
                    now, automaton = part, ahocorasick.Automaton()
                    for name in sought[part].value if part in sought else ():
                        automaton.add_word(name, name)
                    automaton.make_automaton()
                if x and len(automaton):
                    for end, name in automaton.iter(x):
                        if name.endswith(gram):
                            place.append(i)
                            found.append((name, end + 1 - len(name), end + 1))
            if place:
                name, at, stop = zip(*found, strict=True)
                kept = batch.select(columns).take(pa.array(np.array(place)))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept.columns, pa.array(name), pa.array(at), pa.array(stop)], arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, out)


def leftmost(hits: DataFrame, keys: list[str], start: str, stop: str, value: str) -> DataFrame:
    """keys and the distinct values of those hits of each key that a search from the left finds, the longest first, without overlap."""
    each = F.struct(F.col(start).cast("bigint").alias("start"), (-F.col(stop).cast("bigint")).alias("stop"), F.col(value).alias("value"))
    none = F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast("array<string>").alias("taken"))
    step = lambda acc, h: F.when(h["start"] >= acc["last"], F.struct((-h["stop"]).alias("last"), F.concat(acc["taken"], F.array(h["value"])).alias("taken"))).otherwise(acc)
    return hits.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(each)), none, step, lambda acc: F.array_distinct(acc["taken"])).alias(value))
