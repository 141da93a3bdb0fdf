"""Connected components of a table of links, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linefold.llm.store import drop, stage


def to_lowest(links: DataFrame) -> DataFrame:
    """Point every node that stands above another at the lowest node beside either."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    up = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return up.distinct()


def among_lower(links: DataFrame) -> DataFrame:
    """Point every node and its lower neighbours at the lowest of them. ``links`` go downwards."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    others = links.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return others.unionByName(low.withColumnRenamed("low", "b")).distinct()


def settled(links: DataFrame) -> bool:
    """Whether every node points at one that points nowhere."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("up")).unionByName(links.select(F.col("b").alias("id"), F.lit(0).alias("up")))
    return ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or ups = 1 and least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links(a, b)``; the component is its smallest id.

    Rounds over staged tables, each cut from its history; about log2 of the longest path are needed. Self-links and nulls
    are left out. Nothing but one yes or no a round comes to the driver.
    """
    downwards = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(downwards.distinct(), "stars")
    while not settled(now):
        last, now = now, stage(among_lower(to_lowest(now)), "stars")
        drop(last)
    nodes = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(id, component)`` after more links: only components are put together, not all nodes again."""
    of_a = labels.select(F.col("id").alias("a"), F.col("component").alias("x"))
    of_b = labels.select(F.col("id").alias("b"), F.col("component").alias("y"))
    between = links.select("a", "b").join(of_a, "a", "left").join(of_b, "b", "left")
    between = between.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b")
    joined = components(between)
    moved = joined.select(F.col("id").alias("component"), F.col("component").alias("now"))
    nodes = labels.join(moved, "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    return stage(nodes.unionByName(joined.join(labels.select("id"), "id", "left_anti")), "labels")
