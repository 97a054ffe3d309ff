"""Connected components by alternating large-star and small-star steps.

Edges stay in DataFrames; each step is a grouped minimum (combined before the
shuffle) and a join, and is written to the shared folder, so lineage is short.
The count of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(e: DataFrame, large: bool) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:  # only neighbours that are smaller
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = both.join(least, "u")
    if large:
        return j.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))  # repeated edges go in the small step
    out = j.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.where("u != m").select("u", F.col("m").alias("v"))).distinct()


def _settled(e: DataFrame) -> bool:
    """Whether ``e`` is a forest of stars: each u has one v, and no v is a u."""
    ends = e.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.agg(F.max(F.col("out") + F.col("into") * (F.col("out") > 0).cast("int"))).first()[0] in (None, 0, 1)


def components(edges: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b); label is the least node reachable."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e = tmp.keep(e, f"{name}0")
    k = 0
    while not _settled(e):
        k += 1
        e = tmp.keep(_stars(_stars(e, True), False), f"{name}{k}")
        tmp.drop(f"{name}{k - 1}")
    heads = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(heads)


def extend(labels: DataFrame, edges: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """Labels after more edges: only the components that these join are searched again.

    ``labels`` has every node once.  Nodes of ``edges`` that it lacks are added.
    """
    at = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    own = edges.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left")
    own = own.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = tmp.keep(components(own, tmp, name), f"{name}_joined")
    old = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left")
    new = joined.join(labels.select("node"), "node", "left_anti")
    return old.select("node", F.coalesce("now", "label").alias("label")).unionByName(new.select("node", "label"))
