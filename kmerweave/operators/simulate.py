"""Random sequences, reads and mutants, generated where the rows are.

Every random number is a hash of a seed, the row's id and a counter, so results
depend neither on partitioning nor on tasks being run again after a loss.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kmerweave.functions.mutation import MutationModel

BITS = 2.0 ** 53
# Rows mutated together; bounds memory at this many times the longest sequence.
ROWS = 512


def uniform(*parts) -> Column:
    """Uniform number in ``[0, 1)`` determined by its arguments."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.pmod(F.xxhash64(*cols), F.lit(int(BITS))) / F.lit(BITS)


def normal(*parts) -> Column:
    """Standard normal number determined by its arguments."""
    u, v = 1 - uniform(*parts, "radius"), uniform(*parts, "angle")
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * np.pi * v)


def _pick(u, letters, probs):
    """Letter whose share of the unit interval holds ``u``."""
    out, upto = None, 0.0
    for letter, p in list(zip(letters, probs))[:-1]:
        upto += p
        out = F.when(u < upto, letter) if out is None else out.when(u < upto, letter)
    return F.lit(letters[-1]) if out is None else out.otherwise(letters[-1])


def random_letters(size, alphabet, seed, *row, p=None) -> Column:
    """Random sequence of ``size`` independent letters, uniform unless ``p``."""
    probs = p or [1.0 / len(alphabet)] * len(alphabet)
    if len(probs) != len(alphabet) or abs(sum(probs) - 1) > 1e-9:
        raise ValueError("one probability per letter is needed, summing to one")
    size = size if isinstance(size, Column) else F.lit(size)
    letters = F.transform(F.sequence(F.lit(1), size), lambda k: _pick(uniform(seed, *row, k), alphabet.letters, probs))
    return F.when(size > 0, F.array_join(letters, "")).otherwise(F.lit(""))


def random_sequences(spark, count: int, size: int, alphabet, seed=0, p=None) -> DataFrame:
    """``count`` random sequences of one size."""
    return spark.range(count).select(
        F.col("id").alias("seq_id"), random_letters(size, alphabet, seed, F.col("id"), p=p).alias("seq"))


def fill_in_unknown(seq, alphabet, seed, *row) -> Column:
    """Replaces every ``N`` by a random letter."""
    probs = [1.0 / len(alphabet)] * len(alphabet)
    return F.array_join(F.transform(
        F.regexp_extract_all(seq, F.lit("(.)"), F.lit(1)),
        lambda x, k: F.when(x != "N", x).otherwise(_pick(uniform(seed, *row, k), alphabet.letters, probs))), "")


def lossless_reads(seqs: DataFrame, len_mean, len_sd=1.0, expected_coverage=None, num=None, seed=0) -> DataFrame:
    """Substrings with normal lengths and uniform starts:
    ``(seq_id, read, start, seq)``.

    ``num`` reads per sequence, or as many as the expected coverage needs, or one.
    ``len_mean`` is a number or a column and must be smaller than the sequence.
    """
    if num is not None and expected_coverage is not None:
        raise ValueError("give either the number of reads or the coverage")
    n = F.length("seq")
    mean = len_mean if isinstance(len_mean, Column) else F.lit(len_mean)
    if num is not None:
        count = F.lit(num)
    else:
        count = F.lit(1) if expected_coverage is None else F.floor(n * expected_coverage / mean).cast("int")
    short = F.when(mean < n, count).otherwise(F.raise_error(
        F.lit("the mean read length must be smaller than the sequence")).cast("int"))

    def read(k):
        size = F.greatest(F.lit(1), F.least(n - 1, (mean + len_sd * normal(seed, F.col("seq_id"), k, "size")).cast("int")))
        start = F.floor(uniform(seed, F.col("seq_id"), k, "start") * (n - size + 1)).cast("int")
        return F.struct(k.cast("int").alias("read"), start.alias("start"),
                        F.substring("_b", start + 1, size).cast("string").alias("seq"))

    # Bytes make every slice constant-time; only finished reads leave the row.
    rows = seqs.withColumn("_b", F.col("seq").cast("binary"))
    made = rows.select("seq_id", F.explode(F.when(short > 0, F.transform(
        F.sequence(F.lit(0), short - 1), read))).alias("r"))
    return made.select("seq_id", "r.*")


def _mix(x):
    """Splitmix64 finaliser on unsigned arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(state, counter):
    """One uniform number per row for a given draw counter."""
    step = np.uint64((counter * 0x9E3779B97F4A7C15) & (2 ** 64 - 1))
    return (_mix(state + step) >> np.uint64(11)).astype(float) / BITS


def _mutate(codes, state, subst_cdf, insert_cdf, go, ge):
    """Walks all rows in step: letters and operations by step, 255 for none."""
    sizes = np.array([len(c) for c in codes])
    grid = np.zeros((len(codes), max(sizes.max(initial=0), 1)), np.int64)
    for r, c in enumerate(codes):
        grid[r, :len(c)] = c
    live, at, op = np.arange(len(codes)), np.zeros(len(codes), np.int64), np.zeros(len(codes), "U1")
    letters, ops, step = [], [], 0
    live = live[sizes > 0]
    while len(live):
        u, v, x = (_draws(state[live], 3 * step + k) for k in range(3))
        here, was = grid[live, at[live]], op[live]
        in_gap = was != ""
        extend = in_gap & (u < ge)
        close = in_gap & ~extend
        # A closed gap takes a step of its own that emits nothing.
        opened = ~in_gap & (u < go)
        copied = ~in_gap & ~opened
        kind = np.where(extend, was, np.where(opened, np.where(v < 0.5, "D", "I"), ""))
        copy = (x[:, None] >= subst_cdf[here][:, :-1]).sum(axis=1)
        insert = (x[:, None] >= insert_cdf[None, :-1]).sum(axis=1)
        kind = np.where(copied, np.where(copy == here, "M", "S"), kind)
        out_letter, out_op = np.full(len(codes), 255, np.uint8), np.zeros(len(codes), "U1")
        out_letter[live] = np.where(copied, copy, np.where(kind == "I", insert, 255))
        out_op[live] = kind
        letters.append(out_letter)
        ops.append(out_op)
        op[live] = np.where(copied | close, "", kind)
        at[live] += copied | (kind == "D")
        live = live[at[live] < sizes[live]]
        step += 1
    if not ops:
        return None, None
    return np.array(letters).T, np.array(ops).T


def mutate(seq, model: MutationModel, seed=0, row="seq_id") -> Column:
    """Struct column ``(mutant, transcript)``: each position is copied, possibly
    substituted, or a gap opens whose length is geometric."""
    alphabet = model.alphabet
    n = alphabet.letter_len
    index = {x: k for k, x in enumerate(alphabet.letters)}
    subst_cdf, insert_cdf = np.cumsum(np.array(model.subst_probs, float), axis=1), np.cumsum(model.insert_dist)
    table, go, ge = np.array(alphabet.letters), model.go_prob, model.ge_prob

    @F.pandas_udf("mutant string, transcript string")
    def run(seqs: pd.Series, salts: pd.Series) -> pd.DataFrame:
        mutants, transcripts = [""] * len(seqs), [""] * len(seqs)
        order = sorted(range(len(seqs)), key=lambda r: len(seqs[r]))
        for k in range(0, len(order), ROWS):
            rows = order[k:k + ROWS]
            codes = [np.array([index[s[p:p + n]] for p in range(0, len(s), n)], np.int64) for s in (seqs[r] for r in rows)]
            state = salts.to_numpy(np.int64)[rows].view(np.uint64)
            letters, ops = _mutate(codes, state, subst_cdf, insert_cdf, go, ge)
            if ops is None:
                continue
            for q, r in enumerate(rows):
                mutants[r] = "".join(table[letters[q][letters[q] != 255]])
                transcripts[r] = "".join(ops[q])
        return pd.DataFrame({"mutant": mutants, "transcript": transcripts})

    rows = [row] if isinstance(row, str) else list(row)
    return run(seq, F.xxhash64(F.lit(seed), *rows))


def mutants(seqs: DataFrame, model: MutationModel, seed=0) -> DataFrame:
    """Related pairs: every sequence with one mutant and the transcript."""
    out = seqs.withColumn("m", mutate("seq", model, seed))
    return out.select(*seqs.columns, "m.*")


def noisy_reads(seqs: DataFrame, model: MutationModel, seed=0, **kw) -> DataFrame:
    """Lossless reads with mutations: ``(seq_id, read, start, mutant, transcript)``."""
    reads = lossless_reads(seqs, seed=seed, **kw)
    out = reads.withColumn("m", mutate("seq", model, seed, ["seq_id", "read"]))
    return out.select("seq_id", "read", "start", "m.*")


def random_transcripts(spark, count: int, size: int, gap: float, seed=0) -> DataFrame:
    """Independent operations: ``M`` with probability ``1 - gap``, else an insertion
    or a deletion."""
    ops = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: _pick(
        uniform(seed, F.col("id"), k), ["M", "I", "D"], [1 - gap, gap / 2, gap / 2]))
    return spark.range(count).select(F.col("id").alias("seq_id"), F.array_join(ops, "").alias("tx"))


def structural_variant(ref, kind, at, size, alphabet=None, source=0, seed=0, row="seq_id") -> Column:
    """Individual sequence with one insertion, deletion or duplication at ``at``."""
    ref = F.col(ref) if isinstance(ref, str) else ref
    at, size, source = (x if isinstance(x, Column) else F.lit(x) for x in (at, size, source))
    rest = F.length(ref)
    if kind == "insertion":
        return F.concat(F.substring(ref, F.lit(1), at), random_letters(size, alphabet, seed, F.col(row)),
                        F.substring(ref, at + 1, rest))
    if kind == "deletion":
        return F.concat(F.substring(ref, F.lit(1), at), F.substring(ref, at + size + 1, rest))
    if kind == "duplication":
        return F.concat(F.substring(ref, F.lit(1), at), F.substring(ref, source + 1, size), F.substring(ref, at + 1, rest))
    raise ValueError(f"unknown kind of variant: {kind}")


def covers_variant(kind, start, length, at, size, margin) -> Column:
    """Whether a read shows a variant: it must overlap it by at least ``margin`` and
    reach beyond it, on both sides for insertions, at the start for deletions, on
    either side for duplications."""
    start, length, at, size = (F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))
                               for x in (start, length, at, size))
    seen = F.least(start + length, at + size) - F.greatest(start, at) >= margin
    before, after = start < at, start + length > at + size
    wanted = {"insertion": before & after, "deletion": before, "duplication": before | after}
    if kind not in wanted:
        raise ValueError(f"unknown kind of variant: {kind}")
    return seen & wanted[kind]


def planted_genomes(elements: DataFrame, count: int, per_genome: int, alphabet, spacer=200, seed=0,
                    model: MutationModel | None = None) -> DataFrame:
    """Genomes of spacers and planted elements, mutated if a model is given:
    ``(seq_id, seq, elements)``. Each genome takes ``per_genome`` distinct elements
    in the order of a random rank."""
    ranked = elements.withColumn("genome", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn(
        "_rank", F.struct(uniform(seed, F.col("seq_id"), F.col("genome"), "rank").alias("r"), F.col("seq_id").alias("id"), F.col("seq").alias("s")))
    # Only the rows ranked first are gathered, at most per_genome of each genome.
    order = Window.partitionBy("genome").orderBy("_rank.r", "_rank.id")
    kept = ranked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_genome)
    top = kept.groupBy("genome").agg(F.array_sort(F.collect_list("_rank")).alias("top"))
    genome = F.concat(F.aggregate("top", F.lit(""), lambda acc, e: F.concat(
        acc, random_letters(spacer, alphabet, seed, F.col("genome"), e["id"]), e["s"])),
        random_letters(spacer, alphabet, seed, F.col("genome"), F.lit("end")))
    out = top.select(F.col("genome").cast("bigint").alias("seq_id"), genome.alias("seq"),
                     F.transform("top", lambda e: e["id"]).alias("elements"))
    if model is None:
        return out
    return out.withColumn("m", mutate("seq", model, seed)).select("seq_id", F.col("m.mutant").alias("seq"), "elements")

