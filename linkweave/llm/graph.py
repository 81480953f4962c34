"""Connected components by large-star and small-star steps, each step a shared table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .sparkutil import Stage


def _written(df: DataFrame) -> tuple[Stage, tuple]:
    """Edges as a shared table, with their number and a sum of their hashes."""
    seen = Observation()
    stage = Stage(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    found = seen.get
    return stage, (found["n"], found["h"])


def components(edges: DataFrame) -> DataFrame:
    """The least node reachable from each node that has an edge.

    ``edges`` has ``a long, b long``; loops, repeats, either direction and rows
    with a null are allowed (null rows and loops are ignored). Returns
    ``node long, component long``, one row per node of an edge, a written table.
    Minima are combined before each shuffle. A hub's edges meet one row, its
    minimum, so a skewed join may split them over tasks, and the rows of a step
    never outnumber twice its edges.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    held, before = _written(e)
    while before[0]:
        upward = held.df.select(F.col("v").alias("u"), F.col("u").alias("v"))  # edges run from u down to v
        least = held.df.unionByName(upward).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = upward.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # a node's edge to its minimum stays, its other neighbours are linked with that minimum
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after, now = _written(small.distinct())
        held.drop()
        held = after
        if now == before:
            break
        before = now
    stars = held.df
    found = Stage(stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    held.drop()
    return found.df
