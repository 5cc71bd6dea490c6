"""Equi-joins that survive keys holding a large share of the rows on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kmerweave.operators.lineage import cut_lineage

# Rows of one key and side that one task gets on average; a key with more is split.
ROWS_PER_TASK = 1 << 20


def hot_keys(left: DataFrame, right: DataFrame | None, keys, rows_per_task=None) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows on a side, with the number of parts
    for either side; without ``right`` it has as many rows of each key as ``left``. Rows are counted per key before they are shuffled. The result is
    written, so that Spark knows its size and broadcasts it only if that is small."""
    limit = rows_per_task or ROWS_PER_TASK
    if right is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l")).withColumn("_r", F.col("_l"))
    else:
        both = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
            right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        counts = both.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    parts = [F.greatest(F.ceil(F.col(c) / limit), F.lit(1)).cast("int").alias(n)
             for c, n in (("_l", "left_parts"), ("_r", "right_parts"))]
    return cut_lineage(counts.where(F.greatest("_l", "_r") > limit).select(*keys, *parts), "hot")


def salted_sides(left: DataFrame, right: DataFrame, keys, left_spread, right_spread, rows_per_task=None, alike=False):
    """Both sides with the columns ``left_salt`` and ``right_salt``: a hot key becomes a
    grid of parts of either side. A row lies in the part that a hash of its ``spread``
    columns names, and is repeated for every part of the other side, so each pair of
    rows with one key meets in exactly one cell. ``alike``: both sides are one table."""
    hot = hot_keys(left, None if alike else right, keys, rows_per_task)
    sides = []
    for df, spread, own, other in ((left, left_spread, "left", "right"), (right, right_spread, "right", "left")):
        count = lambda side: F.coalesce(f"{side}_parts", F.lit(1))
        sides.append(df.join(hot, keys, "left").withColumn(
            f"{own}_salt", F.pmod(F.xxhash64(*spread), count(own)).cast("int")).withColumn(
            f"{other}_salt", F.explode(F.sequence(F.lit(0), count(other) - 1))).drop("left_parts", "right_parts"))
    return sides


def salted_join(left: DataFrame, right: DataFrame, keys, left_spread, right_spread, rows_per_task=None,
                alike=False) -> DataFrame:
    """Inner join on ``keys`` in which no cell of a hot key holds more than about
    ``rows_per_task`` rows of a side. Exact, as every pair of rows meets once."""
    left, right = salted_sides(left, right, keys, left_spread, right_spread, rows_per_task, alike)
    return left.join(right, [*keys, "left_salt", "right_salt"]).drop("left_salt", "right_salt")
