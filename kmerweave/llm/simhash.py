"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

Two 64-bit fingerprints that differ in at most three bits agree on at least three of six blocks, whichever these are.
Every distinct fingerprint is therefore filed under each of the twenty choices of three blocks (about 32 bits), and only
fingerprints filed together are compared. Copies share one fingerprint and are filed once; a file that is large all the
same is compared part against part, so no task holds more than two parts of it. A task keeps only links that connect
something new, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from kmerweave.llm.common import cut_lineage, fresh, one_row_per_id, texts_of
from kmerweave.operators.components import connected_components, spanning_stars

BITS, SEED, SHINGLE = 64, 42, 3
MAX_DISTANCE, BLOCKS = 3, 6
#: Fingerprints of a file that one task compares with as many others.
PART = 4096

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_OFFSETS = 256 * np.arange(8)


def fingerprint(text: bytes) -> int:
    """Signed 64-bit SimHash of a text's word shingles: a bit is 1 if it is in over half of their XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1:])]
    by_byte = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8) + _BYTE_OFFSETS
    counts = np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, axis=1, bitorder="little").ravel().view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint_of(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype="int64")


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``(doc_id, fp)`` of every row; an empty or null text has fingerprint 0."""
    rows = texts_of(docs, id_col, text_col)
    return rows.select("doc_id", fingerprint_of("text").alias("fp"))


def _block_masks() -> list[int]:
    bounds = [BITS * b // BLOCKS for b in range(BLOCKS + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(bounds, bounds[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, BLOCKS - MAX_DISTANCE)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _near_in_runs(keys, sides, fps) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours in runs of equal keys, up to ``MAX_DISTANCE`` bits apart, as a star forest. ``sides``
    tells which part a row belongs to; -1 stands for a file that has one part."""
    links_u, links_v = [], []
    left = np.arange(len(keys) - 1)
    step = 1
    while len(left):
        left = left[left + step < len(keys)]
        left = left[keys[left] == keys[left + step]]
        right = left + step
        near = (np.bitwise_count(fps[left] ^ fps[right]) <= MAX_DISTANCE) & (
            (sides[left] < 0) | (sides[left] != sides[right]))
        links_u.append(fps[left[near]])
        links_v.append(fps[right[near]])
        step += 1
        if step % 256 == 0:
            merged = spanning_stars(np.concatenate(links_u).view(np.int64), np.concatenate(links_v).view(np.int64))
            links_u, links_v = [merged[0].view(np.uint64)], [merged[1].view(np.uint64)]
    if not links_u:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return spanning_stars(np.concatenate(links_u).view(np.int64), np.concatenate(links_v).view(np.int64))


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal keys of a sorted partition; holds a batch and one run."""
    held = None

    def found(rows):
        u, v = _near_in_runs(*rows)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        keys, sides = (batch.column(c).to_numpy() for c in ("key", "side"))
        rows = (keys, sides, batch.column("fp").to_numpy().view(np.uint64))
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows))
        if not len(rows[0]):
            continue
        cut = len(rows[0]) - _tail(rows[0])
        held = tuple(x[cut:] for x in rows)
        if cut:
            yield found(tuple(x[:cut] for x in rows))
    if held is not None and len(held[0]):
        yield found(held)


def _tail(keys) -> int:
    """Length of the run of equal keys at the end."""
    other = np.flatnonzero(keys != keys[-1])
    return len(keys) - (other[-1] + 1 if len(other) else 0)


def links(fps: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect whatever pairs of the distinct, non-null ``fp`` at most ``MAX_DISTANCE`` bits
    apart connect. Not every close pair is listed: a link is left out where others already connect its ends."""
    filed = fps.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(mask))) for n, mask in enumerate(_block_masks())
    ])).alias("file"))
    shared = filed.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = filed.join(shared, "file").select("fp", "file", parts.alias("parts")).withColumn(
        "part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    cells = dealt.select("fp", "file", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).alias("side"), "fp",
        F.xxhash64("file", F.least("part", "other"), F.greatest("part", "other")).alias("key"))
    near = cells.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "u bigint, v bigint")
    return near.where("u != v")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs``: its fingerprint and the smallest id that links of
    close fingerprints reach from it, its own included.

    Empty and null texts share fingerprint 0. A row with a null id takes part like any other but names no component
    (null if nothing in reach has an id). Repeated rows come out repeated. Other columns are not read.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col), "simhash")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    distinct = cut_lineage(first, "simhash-distinct")
    roots = connected_components(links(distinct))
    rooted = distinct.join(roots, distinct.fp == roots.u, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their near-duplicate component, all columns as they are. Of
    repeated rows with one id, one stays; rows without an id all stay."""
    found = near_duplicates(docs, id_col, text_col)
    kept = fresh(docs, "kept_id")
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias(kept))
    named = docs.where(docs[id_col].isNotNull())
    survivors = named.join(first, named[id_col] == first[kept], "left_semi")
    return one_row_per_id(survivors.unionByName(docs.where(docs[id_col].isNull())), id_col)
