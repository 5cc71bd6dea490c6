"""Evaluation of scores and calls: distributions, classifier curves, error counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kmerweave.operators.lineage import cut_lineage
from kmerweave.operators.skew import salted_join

#: Reads of a bin that one task compares with as many others.
PILE = 1 << 13


def mean_sd(df: DataFrame, value: str, keys) -> DataFrame:
    """Mean and population standard deviation per group."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def empirical_cdf(sample: DataFrame, value: str, at: DataFrame, x: str) -> DataFrame:
    """Empirical distribution function of a sample at the values of another table:
    the share of sample values strictly below ``x``, 0 up to the minimum and 1
    from the maximum on.

    Sample values are counted per distinct value and ranked once by a range-
    partitioned running sum, so neither table is gathered or cross-joined.
    """
    lo, hi, n = sample.agg(F.min(value), F.max(value), F.count(value)).first()
    events = (sample.groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
              .unionByName(at.select(F.col(x).cast("double").alias("_v")).distinct().withColumn(
                  "_c", F.lit(0).cast("bigint"))))
    merged = events.groupBy("_v").agg(F.sum("_c").alias("_c"))
    below = running_total(merged, "_v", "_c", "_below")
    cdf = F.when(F.col(x) >= hi, 1.0).when(F.col(x) <= lo, 0.0).otherwise(
        (F.col("_below") - F.col("_c")) / n)
    return at.join(below, F.col(x).cast("double") == F.col("_v")).withColumn("cdf", cdf).drop(
        "_v", "_c", "_below")


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Running sum over a whole table in order: range partitions are summed up
    separately and shifted by the totals of the partitions before them."""
    parts = df.sparkSession.sparkContext.defaultParallelism * 4
    ranged = df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id())
    # Partition numbers come from one materialised layout, used for both reads.
    ranged = cut_lineage(ranged, "ranged")
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0))
    return ranged.withColumn(out, inside).join(F.broadcast(before), "_part").withColumn(
        out, F.col(out) + F.col("_before")).drop("_part", "_before")


def _curve(scores: DataFrame, score: str, positive: str, margin: float, num_points: int) -> DataFrame:
    """Distribution functions of both classes on a grid of ``num_points``
    thresholds that spans all scores plus a relative margin.

    Scores are binned by the first grid point above them; what is left after that
    single aggregate is two counts per grid point, whatever the number of scores.
    """
    of = {side: F.when(F.col(positive) == flag, F.col(score)) for side, flag in (("pos", True), ("neg", False))}
    ends = scores.agg(
        F.min(score).alias("lo"), F.max(score).alias("hi"),
        *[f(of[side]).alias(f"{n}_{side}") for side in of for f, n in ((F.min, "lo"), (F.max, "hi"), (F.count, "n"))]
    ).first()
    span = (ends["hi"] - ends["lo"]) * margin
    lo, hi = ends["lo"] - span, ends["hi"] + span
    step = (hi - lo) / (num_points - 1)

    def point(k):
        return F.when(k >= num_points - 1, hi).otherwise(F.lit(lo) + k * F.lit(step))

    # The first of the nearby grid points that really lies above the score.
    guess = F.greatest(F.floor((F.col(score) - lo) / step) - 1, F.lit(0)) if step else F.lit(0)
    first = F.array_min(F.filter(F.sequence(guess, guess + 3), lambda k: point(k) > F.col(score)))
    binned = scores.select(
        F.least(F.coalesce(first, F.lit(num_points)), F.lit(num_points)).alias("k"), positive)
    counts = binned.groupBy("k").agg(
        F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    grid = scores.sparkSession.range(num_points).select(
        F.col("id").alias("k"), point(F.col("id")).alias("threshold"))
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # num_points rows
    below = grid.join(counts, "k", "left").fillna(0, ["pos", "neg"])
    for side in of:
        below = below.withColumn(f"n_{side}", F.lit(ends[f"n_{side}"])).withColumn(
            f"cdf_{side}", F.when(F.col("threshold") >= ends[f"hi_{side}"], 1.0)
            .when(F.col("threshold") <= ends[f"lo_{side}"], 0.0)
            .otherwise(F.sum(side).over(upto) / F.col(f"n_{side}")))
    return below.select("k", "threshold", "cdf_pos", "cdf_neg", "n_pos", "n_neg")


def _upper(classifier):
    if classifier not in ("<", ">"):
        raise ValueError("classifier must be '<' or '>'")
    return classifier == ">"


def roc(scores: DataFrame, score="score", positive="positive", classifier=">", num_points=1000) -> DataFrame:
    """ROC curve ``(k, threshold, fpr, tpr)``; ``>`` calls high scores positive."""
    curve = _curve(scores, score, positive, 0.25, num_points)
    x, y = F.col("cdf_neg"), F.col("cdf_pos")
    if _upper(classifier):
        x, y = 1 - x, 1 - y
    return curve.select("k", "threshold", x.alias("fpr"), y.alias("tpr"))


def predictive_values(scores: DataFrame, score="score", positive="positive", classifier=">",
                      num_points=1000) -> DataFrame:
    """Positive and negative predictive value by threshold, NULL where nothing is
    called."""
    c = _curve(scores, score, positive, 0.0, num_points)
    low = {s: F.col(f"cdf_{s}") * F.col(f"n_{s}") for s in ("pos", "neg")}
    high = {s: (1 - F.col(f"cdf_{s}")) * F.col(f"n_{s}") for s in ("pos", "neg")}
    called, rest = (high, low) if _upper(classifier) else (low, high)

    def share(part, whole):
        return F.when(whole != 0, part / whole)

    return c.select("k", "threshold", share(called["pos"], called["pos"] + called["neg"]).alias("ppv"),
                    share(rest["neg"], rest["pos"] + rest["neg"]).alias("npv"))


def call_stats(truth: DataFrame, calls: DataFrame, n_items, key: str, item: str) -> DataFrame:
    """Per key: true and false positives and negatives of called items against
    true items out of ``n_items`` candidates (a number or a column)."""
    n_items = F.lit(n_items) if isinstance(n_items, int) else n_items
    both = (truth.select(key, item).distinct().withColumn("_t", F.lit(True))
            .join(calls.select(key, item).distinct().withColumn("_c", F.lit(True)), [key, item], "full"))
    t, c = F.coalesce("_t", F.lit(False)), F.coalesce("_c", F.lit(False))
    out = both.groupBy(key).agg(F.count_if(t & c).alias("tp"), F.count_if(~t & c).alias("fp"),
                                F.count_if(t & ~c).alias("fn"))
    return out.withColumn("tn", n_items - F.col("tp") - F.col("fp") - F.col("fn"))


def rates(stats: DataFrame) -> DataFrame:
    """True and false positive rate; with no positives at all the first is 1."""
    p, n = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return stats.withColumn("tpr", F.when(p == 0, 1.0).otherwise(F.col("tp") / F.nullif(p, F.lit(0)))).withColumn(
        "fpr", F.col("fp") / F.nullif(n, F.lit(0)))


def overlapping_intervals(reads: DataFrame, min_overlap=50, bin_size=1024, rows_per_task=None) -> DataFrame:
    """Pairs of mapped reads ``(id, strand, start, stop)`` on the same strand whose
    intervals share more than ``min_overlap`` positions: ``(id1, id2, overlap)``,
    ``id1 < id2``.

    A pair meets in the bin in which the later one starts, so a read is repeated only
    in its role as the earlier one. A bin with more than ``rows_per_task`` (by default
    ``PILE``) rows on a side becomes a grid of parts of both, so a task has at most
    about so many of either side however many reads pile up at a place.
    """
    bin_of = lambda at: F.floor(at / bin_size)
    early = reads.select("strand", F.col("id").alias("e_id"), F.col("start").alias("e_start"), F.col("stop").alias("e_stop"),
                         F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.greatest("start", "stop")))).alias("bin"))
    late = reads.select("strand", F.col("id").alias("l_id"), F.col("start").alias("l_start"), F.col("stop").alias("l_stop"),
                        bin_of(F.col("start")).alias("bin"))
    overlap = F.least("e_stop", "l_stop") - F.col("l_start")
    ordered = (F.col("e_start") < F.col("l_start")) | ((F.col("e_start") == F.col("l_start")) & (F.col("e_id") < F.col("l_id")))
    met = salted_join(early, late, ["strand", "bin"], ["e_id"], ["l_id"], rows_per_task or PILE)
    return met.where(ordered & (F.col("e_id") != F.col("l_id")) & (overlap > min_overlap)).select(
        F.least("e_id", "l_id").alias("id1"), F.greatest("e_id", "l_id").alias("id2"), overlap.alias("overlap"))


def time_in_band(paths: DataFrame, radius: int, keys=("seq_id",)) -> DataFrame:
    """Share of the steps of every edit path (operations with the positions in
    front of them) spent on diagonals in ``(-radius, radius]``."""
    d = F.col("i") - F.col("j")
    return paths.groupBy(*keys).agg(
        (F.count_if((d > -radius) & (d <= radius)) / F.count(F.lit(1))).alias("in_band"))


def diagonal_profile(paths: DataFrame) -> DataFrame:
    """Steps per diagonal over all paths, with the running total: ``(d, n, upto)``."""
    hist = paths.groupBy((F.col("i") - F.col("j")).cast("double").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return running_total(hist, "d", "n", "upto")
