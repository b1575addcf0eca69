"""Connected components of a table of links, and lookups that withstand hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Links, at most, that one task takes: then a round needs no shuffle.
FEW = 1 << 16


def components(links: DataFrame, rounds: int = 50, hot_least: int = 1 << 20) -> DataFrame:
    """node and component (its smallest node) of each node of links (a, b).

    Large-star and small-star in turn (Kiveris et al. 2014) until the links no longer change; each round is written, so
    lost executors cost at most that round. Nodes link to ever smaller ones; a star's centre is met by grouped minima and,
    where there are `hot_least` links, by hot_lookup, so no task gathers a component but where all links are FEW. An empty table gives an empty one. Raises
    RuntimeError where the links still change after `rounds` rounds.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    known, n = None, links.count()
    look = lambda rows, table: hot_lookup(rows, written(table, "least"), "a", "n") if n >= hot_least else rows.join(table.drop("n"), "a")
    for _ in range(rounds):
        links = links.coalesce(1) if n <= FEW else links
        # Large star: larger neighbours link to the smallest of a node and its neighbours.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).select("a", F.least("a", "low").alias("low"), "n")
        large = look(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Small star: a node and its smaller neighbours link to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = look(large, least).select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
        links = written(small.where("a <> b").distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == known:
            break
        known, n = tuple(state), state[0]
    else:
        raise RuntimeError(f"links still change after {rounds} rounds")
    # All links now go to centres.
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def hot_lookup(rows: DataFrame, table: DataFrame, key: str, count: str, hot: int = 1000) -> DataFrame:
    """rows joined with table (one row for each key) on `key`; rows with a null key match nothing and are left out.

    Keys that hold over 1/hot of all rows, by the column `count` of the table, are fewer than `hot`, so they are
    broadcast; the rest is an ordinary join, whose keys are all small.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    few = table.where(F.col(count) > total / hot)
    many = table.where(F.col(count) <= total / hot).drop(count)
    hot_rows = rows.join(F.broadcast(few.drop(count)), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(many, key)
    return hot_rows.unionByName(rest)
