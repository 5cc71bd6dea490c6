"""Near copies by SimHash fingerprints, and by the Jaccard similarity of word shingles.

Texts whose SimHash fingerprints link (see ``simhash``: at most three bits, by blocks) are near copies as they stand. At a
similarity of 0.8 fingerprints differ by eight to ten bits, so most edited copies are found by their shingles only.

MinHash bands find candidates for the latter: texts of similarity s share no band with probability ``(1 - s^ROWS)^BANDS``, which
is 5e-8 at 0.8. Texts with the same shingles are filed once. Texts of one file are compared by their whole sets
of shingles, so no pair below the similarity is linked. A file that is large is compared part against part, and a text
that is linked is not compared again with those linked before it, so a dense group costs its length, not its square.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kmerweave.llm.common import cut_lineage, fresh, shuffles_end_with_jobs, texts_of
from kmerweave.llm.hashing import Runs, mix, together, word_hashes
from kmerweave.llm.simhash import fingerprint_of, links as fingerprint_links
from kmerweave.operators.components import connected_components

#: Words of a shingle, and the least similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
#: Shingles of a file's part.
PART = 1 << 19

_SALTS = np.random.default_rng(7).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_XORS, _FACTORS = _SALTS[0], _SALTS[1] * np.uint64(2) + np.uint64(1)


def _sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles in lower case; of fewer words, of all of them."""
    words, first = word_hashes([t.lower() for t in texts])
    sizes = np.diff(first)
    taken = np.where(sizes >= shingle, sizes - shingle + 1, np.minimum(sizes, 1))
    ends = np.cumsum(taken)
    at = np.arange(taken.sum()) + np.repeat(first[:-1] - ends + taken, taken)
    hashes = Runs(words).hash(at, at + np.repeat(np.minimum(sizes, shingle), taken))
    return [np.unique(hashes[a:b]) for a, b in zip(ends - taken, ends)]


def _bands(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for a in range(0, len(hashes), 512):
        least = np.minimum(least, ((hashes[a:a + 512] ^ _XORS[:, None]) * _FACTORS[:, None]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix(keys ^ row) + np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def _content(hashes: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(hashes).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes))).view(np.int64)[0])


def _described(shingle: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()),
                        batch.column("text").to_pylist())
            for keys, texts in together(pairs):
                sets = _sets(texts, shingle)
                yield pa.RecordBatch.from_arrays([
                    pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.array(map(_content, sets), pa.int64()), pa.array(map(len, sets), pa.int64()),
                    pa.array([_bands(s) for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "digest", "content", "n", "bands"])

    return rows


def _listed(shingle: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in together(zip(batch.column("content").to_pylist(), batch.column("text").to_pylist())):
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array([s.tobytes() for s in _sets(texts, shingle)], pa.binary())],
                    names=["content", "shingles"])

    return rows


def near_in_run(contents: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that connect what pairs of at least ``similarity`` connect: breadth first, each text against those that
    nothing has reached so far."""
    links_u, links_v = [], []
    left = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(left, sizes)
    while len(left):
        queue, left = [left[0]], left[1:]
        flat, owner = _without(flat, owner, queue)
        while queue and len(left):
            k = queue.pop()
            at = np.minimum(np.searchsorted(sets[k], flat), max(0, sizes[k] - 1))
            shared = np.bincount(owner[sets[k][at] == flat], minlength=len(sets)) if sizes[k] else np.zeros(len(sets), int)
            both = sizes[left] + sizes[k] - shared[left]
            near = shared[left] >= similarity * both - 1e-9
            found = left[near].tolist()
            if found:
                links_u += [int(contents[k])] * len(found)
                links_v += contents[found].tolist()
                queue += found
                left = left[~near]
                flat, owner = _without(flat, owner, found)
    return links_u, links_v


def _without(flat, owner, gone):
    stays = ~np.isin(owner, gone)
    return flat[stays], owner[stays]


def _compare(similarity: float):
    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition sorted by key; holds a batch and one run."""
        key, contents, sets = None, [], []

        def found():
            u, v = near_in_run(np.array(contents, np.int64), sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for k, content, data in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "shingles"))):
                if k != key:
                    if len(sets) > 1:
                        yield found()
                    key, contents, sets = k, [], []
                contents.append(content)
                sets.append(np.frombuffer(data, np.uint64))
        if len(sets) > 1:
            yield found()

    return links


def fingerprint_files(marked: DataFrame) -> DataFrame:
    """``(content, n, file)``: contents filed under the group of their fingerprint, that is what links of at most three
    bits connect."""
    pairs = cut_lineage(marked.select("content", "n", "fp").distinct(), "minhash-fingerprints")
    roots = connected_components(fingerprint_links(pairs.select("fp").distinct()))
    group = F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp"))
    return pairs.join(roots, pairs.fp == roots.u, "left").select("content", "n", group.alias("file")).distinct()


def keep_first(docs: DataFrame, id_col="doc_id", text_col="text", shingle=SHINGLE, similarity=SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that come first, by id (none last) and then by a hash of the text, in their group: what pairs
    of texts connect whose sets of ``shingle`` words in a row have at least that Jaccard ``similarity``. MinHash bands find
    them.

    Each row is judged by its own text, so of different texts under one id each stays that is first in its group. Of rows
    that repeat id and text one stays. Texts without words are copies of one another.
    """
    digest = F.xxhash64("text")
    texts = texts_of(docs, id_col, text_col).select("doc_id", "text", digest.alias("digest"))
    with shuffles_end_with_jobs(docs.sparkSession):
        marked = cut_lineage(texts.mapInArrow(
            _described(shingle), "doc_id bigint, digest bigint, content bigint, n bigint, bands array<bigint>"), "minhash")
        first = marked.groupBy("content").agg(F.min(_place()).alias("first"), F.first("n").alias("n"),
                                              F.min("digest").alias("digest"), F.first("bands").alias("bands"))
        distinct = cut_lineage(first, "minhash-distinct")
        filed = distinct.select("content", "n", F.explode("bands").alias("file"))
        shared = filed.groupBy("file").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("total")).where("texts > 1")
        parts = F.ceil(F.col("total") / PART).cast("int")
        dealt = cut_lineage(filed.join(shared.select("file", F.greatest(parts, F.lit(1)).alias("parts")), "file").withColumn(
            "part", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int")), "minhash-files")
        cells = dealt.select("content", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "file", "part").select(
            "content", F.xxhash64("file", F.least("part", "other"), F.greatest("part", "other")).alias("key"))
        asked = distinct.join(dealt.select("content").distinct(), "content", "left_semi").select("content", "digest")
        one = texts.select("digest", "text").join(asked, "digest").groupBy("content").agg(F.first("text").alias("text"))
        sets = cut_lineage(one.mapInArrow(_listed(shingle), "content bigint, shingles binary"), "minhash-sets")
        near = cells.join(sets, "content").repartition("key").sortWithinPartitions("key").mapInArrow(
            _compare(similarity), "u bigint, v bigint").where("u != v")
        roots = connected_components(near)
    rooted = distinct.join(roots, distinct.content == roots.u, "left").select(F.coalesce("root", "content").alias("root"), "first")
    keyed, kept, key = _at(docs, rooted.groupBy("root").agg(F.min("first").alias("first")), id_col, text_col)
    rank = fresh(keyed, "copy_number")
    order = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    copies = Window.partitionBy(*key).orderBy(order)
    return keyed.join(kept, key, "left_semi").withColumn(rank, F.row_number().over(copies)).where(
        F.col(rank) == 1).select(*docs.columns)


def keep_first_linked(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that come first, in the order of ``keep_first``, in their group: what pairs of texts connect whose
    SimHash fingerprints link. Rows that repeat id and text all stay, if they are first."""
    texts = texts_of(docs, id_col, text_col)
    with shuffles_end_with_jobs(docs.sparkSession):
        marked = cut_lineage(texts.select("doc_id", F.xxhash64("text").alias("digest"), fingerprint_of("text").alias("fp")), "fingerprints")
        files = cut_lineage(fingerprint_files(marked.select(
            F.col("digest").alias("content"), F.lit(1).cast("bigint").alias("n"), "fp")), "fingerprint-groups")
    first = marked.groupBy(F.col("digest").alias("content")).agg(F.min(_place()).alias("first"))
    keyed, kept, key = _at(docs, first.join(files, "content").groupBy("file").agg(F.min("first").alias("first")), id_col, text_col)
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


def _place():
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")


def _at(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """``docs`` and the places ``first`` of ``kept`` under the same names of columns, and these: of id and text."""
    none, key, text_key = names = [fresh(docs, c) for c in ("no_id", "kept_id", "kept_digest")]
    keyed = docs.withColumns({
        none: docs[id_col].isNull(), key: F.coalesce(docs[id_col].cast("long"), F.lit(0)),
        text_key: F.xxhash64(F.coalesce(docs[text_col].cast("binary"), F.lit(b"")))})
    return keyed, kept.select(F.col("first.none").alias(none), F.coalesce("first.doc_id", F.lit(0)).alias(key),
                              F.col("first.digest").alias(text_key)), names
