"""Seeds: positions ``(i, j)`` at which two sequences share a word.

One table holds the seeds of all pairs, ``(s_id, t_id, kmer, i, j, d, a)``. The
canonical order of the seeds of a pair is ``(kmer, i, j)``; operators that depend
on order compare those columns instead of numbering rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from kmerweave.operators.grid import pair_sums
from kmerweave.operators.kmers import kmer_scan
from kmerweave.operators.lineage import cut_lineage
from kmerweave.operators.skew import salted_join

PAIR = ["s_id", "t_id"]
# Default bound on the broadcast reference, in GB of word table.
ALLOWED_MEMORY_GB = 1.0
BYTES_PER_WORD = 96


def _with_diagonals(seeds: DataFrame) -> DataFrame:
    return seeds.select(*PAIR, "kmer", "i", "j",
                        (F.col("i") - F.col("j")).alias("d"), (F.col("i") + F.col("j")).alias("a"))


def _side(kmers, id_name, pos_name):
    return kmers.select(
        "kmer", F.col("seq_id").alias(id_name), F.col("pos").alias(pos_name))


def fits_broadcast(ref_seqs: DataFrame, allowed_memory=ALLOWED_MEMORY_GB) -> bool:
    """Whether the word table of a reference set stays within the memory bound;
    measured, not assumed: one pass over the sequence lengths."""
    if allowed_memory <= 0:
        raise ValueError("allowed memory must be positive")
    letters = ref_seqs.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    return letters * BYTES_PER_WORD <= allowed_memory * 2 ** 30


def join_kmers(s_kmers: DataFrame, t_kmers: DataFrame, broadcast_s=False) -> DataFrame:
    """Seeds between two word tables. A reference that fits is broadcast, so the
    other side is never shuffled; otherwise both sides shuffle by word, with hot
    words split into parts."""
    s, t = _side(s_kmers, "s_id", "i"), _side(t_kmers, "t_id", "j")
    if broadcast_s:
        return _with_diagonals(t.join(F.broadcast(s), "kmer"))
    return _with_diagonals(salted_join(s, t, ["kmer"], ["s_id", "i"], ["t_id", "j"]))


def seeds_between(s_seqs: DataFrame, t_seqs: DataFrame, alphabet, wordlen, mask=(),
                  allowed_memory=ALLOWED_MEMORY_GB) -> DataFrame:
    """Seeds of every sequence of one set against every sequence of another. A set that
    fits is broadcast, and the other one is dealt by id before it is scanned, so
    what follows by pair shuffles no seed."""
    broadcast_s = fits_broadcast(s_seqs, allowed_memory)
    if not broadcast_s and fits_broadcast(t_seqs, allowed_memory):
        return swap_sides(seeds_between(t_seqs, s_seqs, alphabet, wordlen, mask, allowed_memory))
    if broadcast_s:
        parts = int(t_seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        t_seqs = t_seqs.repartition(parts, "seq_id")
    return join_kmers(kmer_scan(s_seqs, alphabet, wordlen, mask),
                      kmer_scan(t_seqs, alphabet, wordlen, mask), broadcast_s=broadcast_s)


def swap_sides(seeds: DataFrame) -> DataFrame:
    """The same seeds with the roles of both sets exchanged."""
    return seeds.select(F.col("t_id").alias("s_id"), F.col("s_id").alias("t_id"), "kmer", F.col("j").alias("i"),
                        F.col("i").alias("j"), (-F.col("d")).alias("d"), "a")


def seeds_within(seqs: DataFrame, alphabet, wordlen, mask=()) -> DataFrame:
    """Seeds of all pairs ``s_id < t_id`` of one set."""
    kmers = kmer_scan(seqs, alphabet, wordlen, mask)
    return _with_diagonals(salted_join(
        _side(kmers, "s_id", "i"), _side(kmers, "t_id", "j"), ["kmer"], ["s_id", "i"], ["t_id", "j"],
        alike=True).where("s_id < t_id"))


def self_seeds(seqs: DataFrame, alphabet, wordlen, mask=()) -> DataFrame:
    """Seeds of every sequence against itself, stored once: ``i <= j``.

    The join key is (sequence, word); a word that fills a sequence is split on both
    sides. The pairs of one word are this operator's result.
    """
    kmers = kmer_scan(seqs, alphabet, wordlen, mask)
    left = kmers.select(F.col("seq_id").alias("s_id"), "kmer", F.col("pos").alias("i"))
    right = kmers.select(F.col("seq_id").alias("s_id"), "kmer", F.col("pos").alias("j"))
    return _with_diagonals(salted_join(left, right, ["s_id", "kmer"], ["i"], ["j"], alike=True).where("i <= j")
                           .withColumn("t_id", F.col("s_id")))


def self_seed_sums(seqs: DataFrame, alphabet, wordlen, mask=()) -> DataFrame:
    """What ``self_seeds`` adds up to, without listing a seed: ``(s_id, n_stored, n_trivial, d_total, a_total)``.

    The seeds of a word in a sequence are the pairs of its positions, so a position's rank among them says in how many it
    comes last, and the sum of those before it gives their distances. Sequences are dealt by id before they are scanned;
    neither ranks nor sums move a word again.
    """
    kmers = kmer_scan(seqs.repartition("seq_id"), alphabet, wordlen, mask)
    before = Window.partitionBy("seq_id", "kmer").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pos = F.col("pos").cast("bigint")
    ranked = kmers.select("seq_id", pos.alias("pos"), F.count(F.lit(1)).over(before).alias("n"),
                          F.coalesce(F.sum(pos).over(before), F.lit(0)).alias("total"))
    return ranked.groupBy(F.col("seq_id").alias("s_id")).agg(
        F.sum(F.col("n") + 1).alias("n_stored"), F.count(F.lit(1)).alias("n_trivial"),
        F.sum(F.col("total") - F.col("n") * F.col("pos")).alias("d_total"),
        F.sum(F.col("total") + (F.col("n") + 2) * F.col("pos")).alias("a_total"))


def shown_seed_sums(seqs: DataFrame, alphabet, wordlen, mask=()) -> DataFrame:
    """What ``enumerate_seeds`` of ``self_seeds`` off the main diagonal adds up to, again without a seed: ``(s_id, n, a_total,
    d_total)`` of the sequences that have some. A position meets those before it twice, once from either side, so
    diagonals cancel. Sequences without id have no pairs."""
    kmers = kmer_scan(seqs.where("seq_id IS NOT NULL").repartition("seq_id"), alphabet, wordlen, mask)
    before = Window.partitionBy("seq_id", "kmer").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    pos = F.col("pos").cast("bigint")
    ranked = kmers.select("seq_id", "kmer", pos.alias("pos")).select(
        "seq_id", "pos", F.count(F.lit(1)).over(before).alias("n"), F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("total"))
    return ranked.groupBy(F.col("seq_id").alias("s_id")).agg(
        F.sum(2 * F.col("n")).alias("n"), F.sum(2 * (F.col("total") + F.col("n") * F.col("pos"))).alias("a_total"),
        F.lit(0).cast("bigint").alias("d_total")).where("n > 0")


def enumerate_seeds(seeds: DataFrame, d_band=None, exclude_trivial=False, own=False) -> DataFrame:
    """Seeds in a closed diagonal band. With ``own`` the two sides are one set, so
    equal ids mean a self comparison: its seeds are stored once and mirrored here
    (after the band filter), and ``exclude_trivial`` leaves out its main diagonal."""
    if d_band is not None:
        seeds = seeds.where(F.col("d").between(*d_band))
    if not own:
        return seeds
    own = F.col("s_id") == F.col("t_id")
    if exclude_trivial:
        seeds = seeds.where(~(own & (F.col("i") == F.col("j"))))
    mirror = F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    both = F.when(own & (F.col("i") != F.col("j")), F.array(F.struct("i", "j"), mirror)).otherwise(
        F.array(F.struct("i", "j")))
    return _with_diagonals(seeds.withColumn("p", F.explode(both)).select(
        *PAIR, "kmer", "p.i", "p.j"))


def in_bands(d_band=None, a_band=None):
    """Predicate for closed bands of diagonals and antidiagonals."""
    terms = [F.col(c).between(*band) for c, band in (("d", d_band), ("a", a_band)) if band]
    return reduce(lambda x, y: x & y, terms, F.lit(True))


def seed_count(seeds: DataFrame, d_band=None, a_band=None) -> DataFrame:
    """Stored seeds per pair, within closed bands if given; pairs whose seeds all
    lie outside count zero."""
    return seeds.groupBy(*PAIR).agg(F.count_if(in_bands(d_band, a_band)).alias("n_seeds"))


def pair_seed_counts(s_seqs: DataFrame, t_seqs: DataFrame, alphabet, wordlen, mask=(),
                     allowed_memory=ALLOWED_MEMORY_GB) -> DataFrame:
    """Number of seeds per pair without producing the seeds: words are counted
    per sequence first and the counts multiplied."""
    s_kmers = kmer_scan(s_seqs, alphabet, wordlen, mask)
    t_kmers = kmer_scan(t_seqs, alphabet, wordlen, mask)
    s = s_kmers.groupBy("kmer", F.col("seq_id").alias("s_id")).agg(F.count(F.lit(1)).alias("n_s"))
    if fits_broadcast(s_seqs, allowed_memory):
        hits = t_kmers.withColumnRenamed("seq_id", "t_id").join(F.broadcast(s), "kmer")
        return hits.groupBy(*PAIR).agg(F.sum("n_s").alias("n_seeds"))
    t = t_kmers.groupBy("kmer", F.col("seq_id").alias("t_id")).agg(F.count(F.lit(1)).alias("n_t"))
    return pair_sums(cut_lineage(s, "word-counts"), cut_lineage(t, "word-counts"))


def pair_seed_counts_within(seqs: DataFrame, alphabet, wordlen, mask=()) -> DataFrame:
    """Number of seeds of all pairs ``s_id < t_id`` of one set, likewise from word
    counts; hot words are split on both sides."""
    counts = cut_lineage(kmer_scan(seqs, alphabet, wordlen, mask).groupBy("kmer", "seq_id").agg(
        F.count(F.lit(1)).alias("n")), "word-counts")  # read for hot words, then for both sides
    s = counts.select("kmer", F.col("seq_id").alias("s_id"), F.col("n").alias("n_s"))
    t = counts.select("kmer", F.col("seq_id").alias("t_id"), F.col("n").alias("n_t"))
    return salted_join(s, t, ["kmer"], ["s_id"], ["t_id"], alike=True).where("s_id < t_id").groupBy(*PAIR).agg(
        F.sum(F.col("n_s") * F.col("n_t")).alias("n_seeds"))
