"""Range neighbourhoods of seeds without pairing seeds up.

Rows are tiled by diagonal block and antidiagonal stripe, rows near a border are
repeated in the adjacent tile, and counts are window sums inside a tile. A tile
can hold only as many seeds as it has cells, whatever the data look like, so no
pair of sequences, however repetitive, ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kmerweave.operators.seeds import PAIR

OVERLAP_TILE = 16.0
# Halo slack for real-valued keys, far above rounding and far below a unit.
SLACK = 1e-9


def _tile_sizes(d_radius, a_radius):
    return 4 * d_radius, max(4 * a_radius, 256)


def _span(col, reach, size):
    """Tiles touched by ``col ± reach``, as an array."""
    return F.sequence(F.floor((F.col(col) - reach) / size), F.floor((F.col(col) + reach) / size))


def count_neighbors(seeds: DataFrame, d_radius: int, a_radius: int, keys=PAIR) -> DataFrame:
    """Adds ``n_neigh``: other seeds of the same pair within the closed box
    ``|Δd| <= d_radius``, ``|Δa| <= a_radius``.

    One shuffle by (pair, tile). In a tile every seed is repeated on the
    diagonals within reach that really hold seeds, so the box count becomes a
    one-dimensional count along each diagonal.
    """
    d_size, a_size = _tile_sizes(d_radius, a_radius)
    keep = [c for c in seeds.columns if c not in keys]
    rec = F.struct(*keep)
    tiled = (seeds
             .withColumn("bd", F.explode(_span("d", d_radius, d_size)))
             .withColumn("ba", F.explode(_span("a", a_radius, a_size)))
             .select(*keys, "bd", "ba", "d", "a",
                     ((F.floor(F.col("d") / d_size) == F.col("bd"))
                      & (F.floor(F.col("a") / a_size) == F.col("ba"))).alias("own"),
                     rec.alias("rec")))
    tile = [*keys, "bd", "ba"]
    # The diagonals that hold seeds of this tile: at most 4 * d_radius of them.
    occupied = F.collect_set(F.when(F.col("own"), F.col("d"))).over(Window.partitionBy(*tile))
    lines = tiled.withColumn("line", occupied).withColumn("line", F.explode(F.filter(
        "line", lambda x: F.abs(x - F.col("d")) <= d_radius)))
    along = Window.partitionBy(*tile, "line").orderBy("a").rangeBetween(-a_radius, a_radius)
    counted = lines.withColumn("n_neigh", F.count(F.lit(1)).over(along) - 1)
    return counted.where(F.col("own") & (F.col("line") == F.col("d"))).select(
        *keys, "rec.*", "n_neigh")


def count_scaled_band(hist: DataFrame, x: str, n: str, keys=PAIR) -> DataFrame:
    """Adds ``n_band``: the sum of ``n`` over rows of the same pair whose ``x`` lies
    within one unit. ``hist`` is a per-diagonal histogram, so its size is bounded
    by sequence lengths; tiles of ``OVERLAP_TILE`` units bound each window."""
    tiles = F.sequence(F.floor((F.col(x) - 1 - SLACK) / OVERLAP_TILE),
                       F.floor((F.col(x) + 1 + SLACK) / OVERLAP_TILE))
    tiled = hist.withColumn("tile", F.explode(tiles))
    near = Window.partitionBy(*keys, "tile").orderBy(x).rangeBetween(-1, 1)
    return tiled.withColumn("n_band", F.sum(n).over(near)).where(
        F.floor(F.col(x) / OVERLAP_TILE) == F.col("tile")).drop("tile")


def neighbor_edges(seeds: DataFrame, d_radius: int, a_radius: int, keys=PAIR) -> DataFrame:
    """The neighbour pairs themselves, ``(*keys, i, j, d, a, n_i, n_j, n_d, n_a)``,
    for callers that list neighbours. The result is inherently as large as the
    sum of neighbour counts; an equi-join on tiles finds it. Tiles are several
    radii wide, so few seeds are repeated, and only positions are shuffled."""
    d_size, a_size = 4 * d_radius, 8 * a_radius
    me = (seeds.select(*keys, "i", "j", "d", "a")
          .withColumn("bd", F.explode(_span("d", d_radius, d_size)))
          .withColumn("ba", F.explode(_span("a", a_radius, a_size))).drop("d", "a"))
    other = seeds.select(
        *keys, F.col("i").alias("n_i"), F.col("j").alias("n_j"),
        F.floor(F.col("d") / d_size).alias("bd"), F.floor(F.col("a") / a_size).alias("ba"))
    d, a = F.col("i") - F.col("j"), F.col("i") + F.col("j")
    n_d, n_a = F.col("n_i") - F.col("n_j"), F.col("n_i") + F.col("n_j")
    return me.join(other, [*keys, "bd", "ba"]).where(
        (F.abs(d - n_d) <= d_radius) & (F.abs(a - n_a) <= a_radius)
        & ((F.col("i") != F.col("n_i")) | (F.col("j") != F.col("n_j")))).select(
        *keys, "i", "j", d.alias("d"), a.alias("a"), "n_i", "n_j", n_d.alias("n_d"), n_a.alias("n_a"))
