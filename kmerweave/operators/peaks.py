"""Merging positions of interest into peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STRIPE = 1 << 16


def _merge(df, part):
    """Merges neighbouring intervals ``(l, r, radius)`` along ``l``."""
    w = Window.partitionBy(*part).orderBy("l")
    fresh = F.coalesce(F.col("l") >= F.lag("r").over(w) + F.col("radius"), F.lit(True))
    marked = df.withColumn("_new", fresh.cast("int")).withColumn("_peak", F.sum("_new").over(w))
    return marked.groupBy(*part, "_peak").agg(
        F.min("l").alias("l"), F.max("r").alias("r"), F.min_by("radius", "l").alias("radius")).select(
        *part, "l", "r", "radius")


def find_peaks(series: DataFrame, threshold, radius, keys=("seq_id",), idx="idx", x="x",
               length="n") -> DataFrame:
    """Disjoint peak regions ``(*keys, left, right)`` of every series.

    Each value of at least ``threshold`` centres a peak one position wide to both
    sides; a peak that starts within ``radius`` of the previous one's end joins it.
    ``radius`` is a number or a column, ``length`` the column with the series'
    length. Positions are merged inside stripes first, then the stripes' peaks
    along each series, so no window holds a whole long series.
    """
    keys = list(keys)
    radius = radius if not isinstance(radius, int) else F.lit(radius)
    hot = series.where(F.col(x) >= threshold).select(
        *keys, F.floor(F.col(idx) / STRIPE).alias("stripe"),
        F.greatest(F.col(idx) - 1, F.lit(0)).alias("l"),
        F.least(F.col(idx) + 1, F.col(length) - 1).alias("r"), radius.alias("radius"), F.col(idx).alias("_i"))
    # Two positions may share a left end at the very start of a series.
    hot = hot.groupBy(*keys, "stripe", "l").agg(F.max("r").alias("r"), F.min_by("radius", "_i").alias("radius"))
    local = _merge(hot, [*keys, "stripe"])
    return _merge(local, keys).select(*keys, F.col("l").alias("left"), F.col("r").alias("right"))
