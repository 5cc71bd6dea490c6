"""Edit transcripts: strings over ``M S I D`` as column expressions.

``M``/``S`` advance both sequences, ``D`` the origin, ``I`` the mutant.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def projected_len(tx, on="origin") -> Column:
    """Letters of one sequence that a transcript covers."""
    if on not in ("origin", "mutant"):
        raise ValueError("on must be 'origin' or 'mutant'")
    return F.length(F.translate(_c(tx), "I" if on == "origin" else "D", ""))


def is_valid(tx, origin_start, mutant_start, origin_len, mutant_len) -> Column:
    """Whether a transcript is well formed and stays inside both sequences."""
    origin_start, mutant_start = _c(origin_start), _c(mutant_start)
    return (_c(tx).rlike("^[MSID]+$") & (origin_start >= 0) & (mutant_start >= 0)
            & (origin_start + projected_len(tx, "origin") <= _c(origin_len))
            & (mutant_start + projected_len(tx, "mutant") <= _c(mutant_len)))


def runs(tx) -> Column:
    """Maximal runs of one operation, in order."""
    return F.regexp_extract_all(_c(tx), F.lit("(M+|S+|I+|D+)"), F.lit(1))


def score(tx, origin, mutant, origin_start, mutant_start, subst_scores, go_score, ge_score,
          alphabet) -> Column:
    """Score of an alignment: substitution scores along ``M``/``S`` runs and
    ``go + ge * n`` for every gap run of length ``n``.

    Gapped rows are spelled out per run, so a run costs two slices and the whole
    expression one pass; ``subst_scores[i][j]`` is indexed by letter.
    """
    pairs = F.create_map(*[
        F.lit(v) for i, x in enumerate(alphabet.letters) for j, y in enumerate(alphabet.letters)
        for v in (x + y, float(subst_scores[i][j]))])
    n = alphabet.letter_len
    origin, mutant = _c(origin), _c(mutant)

    def step(acc, run):
        size, op = F.length(run), F.substring(run, 1, 1)
        o = alphabet.tokens(F.substring(origin, acc["i"] * n + 1, size * n))
        m = alphabet.tokens(F.substring(mutant, acc["j"] * n + 1, size * n))
        paired = F.aggregate(F.zip_with(o, m, lambda x, y: F.element_at(pairs, F.concat(x, y))),
                             F.lit(0.0), lambda s, x: s + x)
        gained = F.when(op.isin("M", "S"), paired).otherwise(
            F.lit(float(go_score)) + F.lit(float(ge_score)) * size)
        return F.struct(
            (acc["i"] + F.when(op == "I", 0).otherwise(size)).alias("i"),
            (acc["j"] + F.when(op == "D", 0).otherwise(size)).alias("j"),
            (acc["score"] + gained).alias("score"))

    start = F.struct(_c(origin_start).cast("int").alias("i"), _c(mutant_start).cast("int").alias("j"),
                     F.lit(0.0).alias("score"))
    return F.aggregate(runs(tx), start, step, lambda acc: acc["score"])


def truncate_to_match(tx, origin_start, mutant_start):
    """``(transcript, origin_start, mutant_start)`` trimmed to the first and last
    ``M``; NULL when no more than one column is left or there is no match."""
    tx = _c(tx)
    inner = F.regexp_extract(tx, "^[^M]*(M.*M)[^M]*$", 1)
    lead = F.regexp_extract(tx, "^([^M]*)M", 1)
    keep = F.length(inner) > 1
    return (F.when(keep, inner),
            F.when(keep, _c(origin_start) + projected_len(lead, "origin")),
            F.when(keep, _c(mutant_start) + projected_len(lead, "mutant")))


def gapped(seq, tx, start, skip, letter_len=1) -> Column:
    """One line of an alignment: letters of the sequence with ``-`` where the
    transcript skips it (``I`` for the origin, ``D`` for the mutant)."""
    seq, gap = _c(seq), "-" * letter_len
    step = F.aggregate(
        runs(tx), F.struct(_c(start).cast("int").alias("at"), F.lit("").alias("line")),
        lambda acc, run: F.struct(
            (acc["at"] + F.when(run.startswith(skip), 0).otherwise(F.length(run))).alias("at"),
            F.concat(acc["line"], F.when(run.startswith(skip), F.repeat(F.lit(gap), F.length(run))).otherwise(
                F.substring(seq, acc["at"] * letter_len + 1, F.length(run) * letter_len))).alias("line")),
        lambda acc: acc["line"])
    return step


def remove_long_gaps(tx, max_gap=100) -> Column:
    """Deletes runs of at least ``max_gap`` insertions or deletions."""
    return F.regexp_replace(_c(tx), "D{%d,}|I{%d,}" % (max_gap, max_gap), "")


# -- per-position views ------------------------------------------------------
#
# A transcript is cut into chunks before it is exploded. A chunk knows how many
# letters of either sequence are in front of it, and brings along as many
# neighbouring operations as a window reaches over. Chunks are what is dealt over the
# tasks; an Arrow function reads positions and windows off running counts of a chunk,
# so exploded rows are neither sorted nor shuffled.

#: Operations of a chunk, if windows are not wide.
CHUNK = 1 << 13
#: Rows that leave Python together.
ROWS = 1 << 16


def _chunks(df, tx, keys, before=0, after=0):
    """``(*keys, _chunk, _parts)``: what a chunk reads of its transcript, ``before`` and ``after`` operations around it
    included. Transcripts whose keys are equal share their chunks."""
    size = max(CHUNK, 4 * (before + after))
    data = df.select(*keys, F.col(tx).cast("binary").alias("_b"), F.length(tx).alias("_n")).where("_n > 0")
    numbers = F.sequence(F.lit(0), F.ceil(F.col("_n") / size).cast("int") - 1)

    def letters(part, others):
        return F.length(F.translate(part.cast("string"), others, ""))

    def in_front(others):
        counts = F.transform(numbers, lambda c: letters(F.substring("_b", c * size + 1, F.lit(size)), others))
        return F.aggregate(counts, F.array(F.lit(0)), lambda upto, x: F.concat(upto, F.array(F.element_at(upto, -1) + x)))

    lead = F.least(F.col("_chunk") * size, F.lit(before))
    chunks = data.select(*keys, "_b", "_n", in_front("I$").alias("_is"), in_front("D$").alias("_js"),
                         F.explode(numbers).alias("_chunk"))
    halo = F.substring("_b", F.col("_chunk") * size - lead + 1, lead)
    return chunks.select(*keys, "_chunk", F.struct(
        F.col("_n").alias("n"), (F.col("_chunk") * size).alias("first"), ((F.col("_chunk") + 1) * size).alias("end"),
        (F.col("_chunk") * size - lead).alias("at"),
        F.substring("_b", F.col("_chunk") * size - lead + 1, lead + size + after).alias("ops"),
        (F.get("_is", F.col("_chunk")) - letters(halo, "I$")).alias("i"),
        (F.get("_js", F.col("_chunk")) - letters(halo, "D$")).alias("j")).alias("_part")).groupBy(*keys, "_chunk").agg(
            F.collect_list("_part").alias("_parts"))


def _read(parts):
    """Columns of a chunk's operations, halos included, in order: ``(idx, op, i, j, n, own)``."""
    one = lambda k, x: np.full(len(parts[k]["ops"]), x, np.int32)
    ops = np.concatenate([np.frombuffer(p["ops"], np.uint8) for p in parts])
    idx = np.concatenate([np.arange(len(p["ops"]), dtype=np.int32) + np.int32(p["at"]) for p in parts])
    i, j, n = (np.concatenate([one(k, p[c]) for k, p in enumerate(parts)]) for c in ("i", "j", "n"))
    if len(parts) > 1:
        order = np.argsort(idx, kind="stable")
        ops, idx, i, j, n = (x[order] for x in (ops, idx, i, j, n))
    for at, others in ((i, b"I$"), (j, b"D$")):
        steps = ~np.isin(ops, np.frombuffer(others, np.uint8))
        at += np.cumsum(steps, dtype=np.int32) - steps
    return idx, ops, i, j, n, (idx >= parts[0]["first"]) & (idx < parts[0]["end"])


def _seen(ops, kinds, first, last):
    """How many of the operations from ``first`` to ``last`` around each are of the given kinds."""
    upto = np.concatenate([[0], np.cumsum(np.isin(ops, np.frombuffer(kinds.encode(), np.uint8)))])
    at = np.arange(len(ops))
    return (upto[np.clip(at + last + 1, 0, len(ops))] - upto[np.clip(at + first, 0, len(ops))]).astype(np.int32)


def _letters(ops):
    offsets = pa.py_buffer(np.arange(len(ops) + 1, dtype=np.int32))
    return pa.StringArray.from_buffers(len(ops), offsets, pa.py_buffer(np.ascontiguousarray(ops)))


_KINDS = [("_n", T.IntegerType()), ("idx", T.IntegerType()), ("op", T.StringType()), ("i", T.IntegerType()),
          ("j", T.IntegerType()), ("_seen", T.IntegerType()), ("_kept", T.IntegerType())]


def _by_chunk(df, tx, keys, before=0, after=0, counted="", kept="", around=(0, 0)):
    """One row per chunk with its operations as an array: ``(*keys, _chunk, _ops)``. ``_n`` is the transcript's length,
    ``_seen`` and ``_kept`` how many of the ``counted`` and ``kept`` operations are in the window ``around`` an operation,
    which reaches over no more than ``before`` and ``after``."""
    chunks = _chunks(df, tx, keys, before, after)
    out = T.StructType([*chunks.schema.fields[:-1], T.StructField("_ops", T.ArrayType(T.StructType(
        [T.StructField(*kind) for kind in _KINDS])))])
    names = [name for name, _ in _KINDS]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own_keys, parts = batch.columns
            waiting, size, start = [], 0, 0
            for k in range(batch.num_rows):
                idx, ops, i, j, n, own = _read(parts[k].as_py())
                seen = [_seen(ops, some, *around) for some in (counted, kept)]
                waiting.append([x[own] for x in (n, idx, ops, i, j, *seen)])
                size += len(idx)
                if size >= ROWS or k == batch.num_rows - 1:
                    ends = np.cumsum([0] + [len(x[0]) for x in waiting], dtype=np.int32)
                    whole = [np.concatenate(x) for x in zip(*waiting)]
                    each = pa.StructArray.from_arrays([_letters(x) if name == "op" else pa.array(x) for name, x in zip(names, whole)],
                                                      names=names)
                    yield pa.RecordBatch.from_arrays([*(x.slice(start, k + 1 - start) for x in own_keys),
                                                      pa.ListArray.from_arrays(ends, each)], names=out.names)
                    waiting, size, start = [], 0, k + 1

    return chunks.mapInArrow(rows, out)


def _operations(df, tx, keys, *args, **kw):
    """The operations of ``_by_chunk``, a row each: ``(*keys, _chunk, _n, idx, op, i, j, _seen)``."""
    each = _by_chunk(df, tx, keys, *args, **kw).select(*keys, "_chunk", F.posexplode("_ops").alias("_p", "_o"))
    return each.select(*keys, "_chunk", *[F.col(f"_o.{name}").alias(name) for name, _ in _KINDS])


def positions(df: DataFrame, tx="tx", keys=("seq_id",)) -> DataFrame:
    """One row per operation with the sequence positions in front of it:
    ``(*keys, idx, op, i, j)``. ``keys`` tell transcripts apart."""
    return _operations(df, tx, list(keys)).select(*keys, "idx", "op", "i", "j")


def path(df: DataFrame, tx="tx", keys=("seq_id",), x0=0, y0=0) -> DataFrame:
    """Cumulative path of a transcript, including its start:
    ``(*keys, step, x, y)`` with ``length + 1`` points."""
    marked = df.withColumn(tx, F.concat(F.col(tx), F.lit("$")))
    return positions(marked, tx, keys).select(
        *keys, F.col("idx").alias("step"), (F.col("i") + x0).alias("x"), (F.col("j") + y0).alias("y"))


def _sliding(df, radius, tx, keys, ops):
    at = _operations(df, tx, list(keys), radius, radius - 1, "".join(ops), around=(-radius, radius - 1))
    inner = (F.col("idx") >= radius) & (F.col("idx") < F.col("_n") - radius)
    return at.withColumn("share", F.col("_seen") / (2.0 * radius)).withColumn("inner", inner)


def match_rate(df, radius, tx="tx", keys=("seq_id",), more=()) -> DataFrame:
    """Share of ``M`` among the ``2 * radius`` operations around each position, 0 in the
    flanks, which is everywhere in transcripts that are no longer than that. ``more`` may
    name ``_n``, the transcript's length."""
    out = _sliding(df, radius, tx, keys, "M")
    return out.select(*keys, "idx", "op", "i", "j", *more,
                      F.when(F.col("inner"), F.col("share")).otherwise(F.lit(0.0)).alias("p_match"))


def gap_rate(df, radius, tx="tx", keys=("seq_id",)) -> DataFrame:
    """Share of insertions and deletions around each position, same frame."""
    out = _sliding(df, radius, tx, keys, "MS")
    return out.select(*keys, "idx", "op", "i", "j",
                      F.when(F.col("inner"), 1 - F.col("share")).otherwise(F.lit(0.0)).alias("p_gap"))


def projected_match_rate(df, radius, on="origin", tx="tx", keys=("seq_id",)) -> DataFrame:
    """Match rate by position of one sequence; of the operations in front of the
    same letter the last one counts."""
    at = "i" if on == "origin" else "j"
    keys = list(keys)
    counted = df.select(*keys, F.col(tx).alias("_tx"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_same"))
    # The last operation in front of a letter is the one that passes it, or the transcript's last. Transcripts that share
    # their keys share positions, too.
    passes = F.col("op").isin(*("MSD" if on == "origin" else "MSI")) | (F.col("idx") == F.col("_n") - 1)
    alone = match_rate(counted.where("_same = 1"), radius, "_tx", keys, ["_n"]).where(passes)
    shared = match_rate(counted.where("_same > 1"), radius, "_tx", keys)
    return alone.select(*keys, F.col(at).alias("pos"), "p_match").unionByName(
        shared.groupBy(*keys, F.col(at).alias("pos")).agg(F.max_by("p_match", "idx").alias("p_match")))


def matching_words(df, wordlen, tx="tx", keys=("seq_id",)) -> DataFrame:
    """Positions at which ``wordlen`` matches in a row start: ``(*keys, idx, i, j)``."""
    return _operations(df, tx, list(keys), 0, wordlen - 1, "M", around=(0, wordlen - 1)).where(F.col("_seen") == wordlen).select(
        *keys, "idx", "i", "j")


def sample_windows(df, length, n_samples, gap=None, match=None, resolution=1e-3, tx="tx",
                   key="seq_id", seed=0) -> DataFrame:
    """Windows of a transcript whose local gap and match rates are within
    ``resolution`` of the targets, ``n_samples`` per transcript drawn with
    replacement: ``(key, n_candidates, draw, idx, window)``. A transcript with no more
    than ``n_samples`` candidates has too few; it comes as one row without a draw.
    Candidates stay in lists by chunk and are numbered by the lists' lengths, so only
    drawn windows are cut out."""
    radius = length // 2
    sized = df.where(F.length(tx) > radius).select(key, F.length(tx).alias("_len"))

    def near(o):
        inner = (o["idx"] >= radius) & (o["idx"] < o["_n"] - radius)
        rates = (match, o["_seen"] / (2.0 * radius)), (gap, 1 - o["_kept"] / (2.0 * radius))
        hits = [F.abs(F.when(inner, rate).otherwise(F.lit(0.0)) - target) < resolution for target, rate in rates if target is not None]
        return reduce(lambda x, y: x & y, hits, F.lit(True))

    lists = _by_chunk(df, tx, [key], radius, radius - 1, "M", "MS", (-radius, radius - 1)).select(
        key, "_chunk", F.transform(F.filter("_ops", near), lambda o: o["idx"]).alias("_at"))
    lists = lists.join(sized, key).select(key, "_chunk", F.filter("_at", lambda x: x < F.col("_len") - radius).alias("_at"))
    lists = lists.groupBy(key, "_chunk").agg(F.array_sort(F.flatten(F.collect_list("_at"))).alias("_at"))
    line = Window.partitionBy(key).orderBy("_chunk")
    numbered = lists.select(
        key, "_at", F.sum(F.size("_at")).over(Window.partitionBy(key)).alias("_n"), F.row_number().over(line).alias("_list"),
        F.coalesce(F.sum(F.size("_at")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = lambda draw: F.pmod(F.xxhash64(F.lit(seed), F.col(key), draw), F.col("_n")) - F.col("_before")
    here = F.filter(F.sequence(F.lit(0), F.lit(n_samples - 1)), lambda draw: (at(draw) >= 0) & (at(draw) < F.size("_at")))
    none, few = F.array().cast("array<int>"), F.array(F.lit(None).cast("int"))
    draws = df.select(key).join(numbered, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn(
        "draw", F.explode(F.when(F.col("_n") > n_samples, here).when(F.coalesce("_list", F.lit(1)) == 1, few).otherwise(none)))
    drawn = draws.select(key, "_n", "draw", F.when(
        F.col("draw").isNotNull(), F.get("_at", at(F.col("draw")).cast("int"))).alias("idx"))
    # A window never starts in front of the transcript.
    start = F.greatest(F.col("idx") - radius, F.lit(0))
    return (drawn.join(df.select(key, tx), key)
            .select(key, F.col("_n").alias("n_candidates"), "draw", "idx", F.substring(F.col(tx), start + 1, F.col("idx") + radius - start).alias("window")))
