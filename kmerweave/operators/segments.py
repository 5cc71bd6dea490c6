"""Similar segments: boxes in diagonal coordinates around connected seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kmerweave.functions import stats
from kmerweave.operators.components import connected_components
from kmerweave.operators.lineage import cut_lineage
from kmerweave.operators.neighbors import _span, _tile_sizes, count_neighbors
from kmerweave.operators.seeds import PAIR, enumerate_seeds


def seed_order(order="kmer"):
    """Order of the seeds of a pair: by word (stored seeds) or by position in the
    scanned sequence (one reference probed by many)."""
    if order == "kmer":
        return F.struct("kmer", "i", "j")
    if order == "position":
        return F.struct("j", "i")
    raise ValueError(f"unknown seed order: {order}")


def score_seeds(seeds: DataFrame, length: int, g_max: float, sensitivity: float,
                n_letters: int, wordlen: int) -> DataFrame:
    """Adds ``n_neigh`` and the match probability ``p`` of a segment of the given
    length centred at each seed."""
    d_radius = stats.band_radius_value(length, g_max, sensitivity)
    scored = count_neighbors(seeds, d_radius, length)
    return scored.withColumn("p", stats.match_probability(
        F.col("n_neigh") + 1, 2 * d_radius * length, length, n_letters, wordlen))


def qualifying_seeds(scored: DataFrame, p_min: float, at_least_one=False,
                     order="kmer") -> DataFrame:
    """Seeds with ``p >= p_min``; with ``at_least_one`` a pair without any keeps its
    first seed of highest probability. One aggregate per pair supplies that seed
    in full, so nothing is joined back."""
    good = scored.where(F.col("p") >= p_min)
    if not at_least_one:
        return good
    cols = [c for c in scored.columns if c not in PAIR]
    best = scored.groupBy(*PAIR).agg(
        F.min(F.struct((-F.col("p")).alias("_p"), seed_order(order).alias("_o"),
                       F.struct(*cols).alias("rec"))).alias("best"))
    return good.unionByName(
        best.where(-F.col("best._p") < p_min).select(*PAIR, "best.rec.*"))


def diagonal_runs(seeds: DataFrame, a_radius: int, a_size: int, order="kmer") -> DataFrame:
    """Collapses seeds that follow each other on a diagonal within ``a_radius``
    into runs, the nodes of the segment graph; cut at stripe borders so that a
    window never exceeds one stripe of one diagonal."""
    stripe = [*PAIR, "d", "stripe"]
    w = Window.partitionBy(*stripe).orderBy("a")
    gap = F.coalesce(F.col("a") - F.lag("a").over(w) > a_radius, F.lit(True))
    marked = (seeds.withColumn("stripe", F.floor(F.col("a") / a_size))
              .withColumn("_new", gap.cast("int"))
              .withColumn("run", F.sum("_new").over(w)))
    return marked.groupBy(*stripe, "run").agg(
        F.min("a").alias("a_lo"), F.max("a").alias("a_hi"),
        F.sum("p").alias("p_sum"), F.count(F.lit(1)).alias("n_run"),
        F.min(F.struct(seed_order(order).alias("o"), F.col("p").alias("p"))).alias("first"),
    ).drop("run")


def run_edges(runs: DataFrame, d_radius: int, a_radius: int, d_size: int, a_size: int) -> DataFrame:
    """Links runs that hold neighbouring seeds.

    Inside a run consecutive seeds are at most ``a_radius`` apart, so two runs on
    diagonals within reach hold neighbouring seeds exactly if their extents come
    within ``a_radius``; comparing extents therefore replaces comparing seeds.
    """
    ahead = (runs.select(*PAIR, "u", "d", "a_lo", "a_hi", "stripe")
             .withColumn("bd", F.explode(_span("d", d_radius, d_size)))
             .withColumn("ba", F.explode(F.sequence(
                 F.col("stripe"), F.floor((F.col("a_hi") + a_radius) / a_size)))))
    here = runs.select(*PAIR, F.col("u").alias("v"), F.col("d").alias("d2"),
                       F.col("a_lo").alias("a_lo2"), F.floor(F.col("d") / d_size).alias("bd"),
                       F.col("stripe").alias("ba"))
    return ahead.join(here, [*PAIR, "bd", "ba"]).where(
        (F.abs(F.col("d") - F.col("d2")) <= d_radius)
        & (F.col("a_lo2") <= F.col("a_hi") + a_radius)
        & ((F.col("a_lo") < F.col("a_lo2"))
           | ((F.col("a_lo") == F.col("a_lo2")) & (F.col("d") < F.col("d2"))))
    ).select("u", "v")


def segments_of(good: DataFrame, s_seqs: DataFrame, t_seqs: DataFrame, d_radius: int,
                a_radius: int, order="kmer") -> DataFrame:
    """Bounding boxes of the connected groups of qualifying seeds, clipped to the
    table, with the mean match probability in which a group's first seed counts
    twice: ``(s_id, t_id, root, d_min, d_max, a_min, a_max, p, n_qualified)``."""
    d_size, a_size = _tile_sizes(d_radius, a_radius)
    # Numbered as they are written, so the numbers stay the same afterwards.
    runs = cut_lineage(diagonal_runs(good, a_radius, a_size, order).withColumn(
        "u", F.monotonically_increasing_id()), "runs")
    roots = connected_components(run_edges(runs, d_radius, a_radius, d_size, a_size))
    labelled = runs.join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))
    boxes = labelled.groupBy(*PAIR, "root").agg(
        (F.min("d") - d_radius).alias("d_min"), (F.max("d") + d_radius).alias("d_max"),
        (F.min("a_lo") - a_radius).alias("a_min"), (F.max("a_hi") + a_radius).alias("a_max"),
        F.sum("p_sum").alias("p_sum"), F.sum("n_run").alias("n_qualified"),
        F.min("first").alias("first"))
    s_len, t_len = F.col("s_len"), F.col("t_len")

    def clip(d):
        return F.least(s_len, F.greatest(F.col(d), -t_len))

    return with_lengths(boxes, s_seqs, t_seqs).select(
        *PAIR, "root", clip("d_min").alias("d_min"), clip("d_max").alias("d_max"),
        F.greatest("a_min", F.lit(0)).alias("a_min"),
        F.least(F.col("a_max"), s_len + t_len).alias("a_max"),
        ((F.col("p_sum") + F.col("first.p")) / (F.col("n_qualified") + 1)).alias("p"),
        "n_qualified")


def count_in_boxes(boxes: DataFrame, seeds: DataFrame, d_size: int, a_size: int) -> DataFrame:
    """Adds ``n_seeds``, the stored seeds inside each closed box. Boxes are repeated
    on the tiles they cover and meet the seeds of those tiles in one equi-join;
    ``root`` tells equal boxes apart."""
    def tiles(lo, hi, size):
        return F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))

    covered = boxes.withColumn("bd", tiles("d_min", "d_max", d_size)).withColumn(
        "ba", tiles("a_min", "a_max", a_size))
    placed = seeds.select(*PAIR, "d", "a", F.floor(F.col("d") / d_size).alias("bd"),
                          F.floor(F.col("a") / a_size).alias("ba"))
    inside = F.col("d").between(F.col("d_min"), F.col("d_max")) & F.col("a").between(F.col("a_min"), F.col("a_max"))
    return covered.join(placed, [*PAIR, "bd", "ba"], "left").groupBy(*boxes.columns).agg(
        F.count_if(inside).alias("n_seeds"))


def keyed(seqs: DataFrame, value, name: str) -> DataFrame:
    """A value per sequence, ``(seq_id, name)``, stored before it is joined by id.
    Spark may otherwise evaluate a costly derivation once per joined row instead of
    once per sequence; stored, the join stays open to broadcasting and to the
    splitting of skewed ids."""
    return cut_lineage(seqs.select("seq_id", value.alias(name)), name)


def _as_side(values, id_name, name):
    return values.toDF(id_name, name)


def with_lengths(pairs: DataFrame, s_seqs: DataFrame, t_seqs: DataFrame) -> DataFrame:
    """Adds the lengths of both sequences to rows keyed by pair."""
    s = keyed(s_seqs, F.length("seq"), "len")
    t = s if t_seqs is s_seqs else keyed(t_seqs, F.length("seq"), "len")
    return pairs.join(_as_side(s, "s_id", "s_len"), "s_id").join(_as_side(t, "t_id", "t_len"), "t_id")


def with_sequences(pairs: DataFrame, s_seqs: DataFrame, t_seqs: DataFrame) -> DataFrame:
    """Adds both sequences, ``origin`` and ``mutant``, to rows keyed by pair; only
    sequences that occur in a pair are stored."""
    pairs = cut_lineage(pairs, "pairs")

    def needed(seqs, id_name):
        ids = pairs.select(F.col(id_name).alias("seq_id"))
        return keyed(seqs.join(ids, "seq_id", "left_semi"), F.col("seq"), "seq")

    return (pairs.join(_as_side(needed(s_seqs, "s_id"), "s_id", "origin"), "s_id")
            .join(_as_side(needed(t_seqs, "t_id"), "t_id", "mutant"), "t_id"))


def similar_segments(seeds: DataFrame, s_seqs: DataFrame, t_seqs: DataFrame, *, k_min: int,
                     p_min: float, g_max: float, sensitivity: float, n_letters: int,
                     wordlen: int, at_least_one=False, order="kmer", own=False) -> DataFrame:
    """All maximal local similarities of at least the given length and match
    probability, for every pair of a stored seed table at once. ``own`` says that both
    sides are one set, as in :func:`enumerate_seeds`.

    Columns: pair, box, ``p``, ``n_qualified`` (seeds that formed the segment),
    ``n_seeds`` (stored seeds inside the clipped box), ``z_h0``, ``z_h1``.
    """
    d_radius = stats.band_radius_value(k_min, g_max, sensitivity)
    d_size, a_size = _tile_sizes(d_radius, k_min)
    if own:
        seeds = cut_lineage(seeds, "seeds")  # read twice below; those of two sets are scanned twice instead
    scored = score_seeds(enumerate_seeds(seeds, exclude_trivial=True, own=own), k_min, g_max,
                         sensitivity, n_letters, wordlen)
    good = qualifying_seeds(scored, p_min, at_least_one, order)
    boxes = cut_lineage(segments_of(good, s_seqs, t_seqs, d_radius, k_min, order), "boxes")
    counted = count_in_boxes(boxes, seeds, d_size, a_size)
    length, area = stats.segment_dims("d_min", "d_max", "a_min", "a_max")
    z0, z1 = stats.score_num_seeds("n_seeds", area, length, "p", n_letters, wordlen)
    return counted.withColumn("z_h0", z0).withColumn("z_h1", z1).drop("root")
