"""Near copies by circulant MinHash: two permutations yield every coordinate of a signature.

The first permutation puts a shingle at a place of a circle of 2^32, the second ranks the places. Coordinate ``k`` is
the least rank of a set's places after the circle is turned by ``k`` steps, so no other permutation is needed. Bands of
``ROWS`` coordinates are filed; a pair at similarity 0.8 shares none of ``BANDS`` bands with probability 2e-8.

Nothing below the similarity is linked, as links are confirmed on full sets, and no pairs within a file are listed:

1. texts with one set are one node;
2. every text of a file is compared with one leader of the file, the text of the largest set, in one join for all files;
3. files whose texts are connected by then are done. In the others the texts that are not connected are compared with
   each other inside tasks, part against part where a file is large.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType

from kmerweave.llm.common import cut_lineage, shuffles_end_with_jobs, texts_of
from kmerweave.llm.hashing import Runs, mix, together, word_hashes
from kmerweave.operators.components import connected_components

#: Words of a shingle, and the least similarity as shared shingles of all, in percent.
SHINGLE, PERCENT = 2, 80
BANDS, ROWS = 45, 5
#: Shingles of a part of a file.
PART = 1 << 19

_PLACE = np.uint64(0xD1342543DE82EF95)
_RANKS = tuple(np.uint32(c) for c in (0x21F0AAAD, 0x735A2D97))


def sets_of(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each text's distinct shingles, one text after another, and where each text's begin (one more
    entry: the end). A text of fewer words than a shingle has one, all its words; one without words has none."""
    words, first = word_hashes([t.lower() for t in texts])
    sizes = np.diff(first)
    taken = np.where(sizes >= shingle, sizes - shingle + 1, np.minimum(sizes, 1))
    ends = np.cumsum(taken)
    at = np.arange(taken.sum()) + np.repeat(first[:-1] - ends + taken, taken)
    hashes = Runs(words).hash(at, at + np.repeat(np.minimum(sizes, shingle), taken))
    owner = np.repeat(np.arange(len(texts)), taken)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[new], minlength=len(texts))
    return hashes[new], np.concatenate([[0], np.cumsum(counts)])


def _rank(place: np.ndarray) -> np.ndarray:
    """The second permutation: one to one on 32 bits."""
    with np.errstate(over="ignore"):
        place = (place ^ (place >> np.uint32(16))) * _RANKS[0]
        place = (place ^ (place >> np.uint32(15))) * _RANKS[1]
        return place ^ (place >> np.uint32(15))


def signatures(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates (columns) of every set (rows); an empty set has the largest rank everywhere."""
    with np.errstate(over="ignore"):
        place = (mix(hashes) * _PLACE >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(first))
    out = np.full((len(first) - 1, size), (1 << 32) - 1, np.uint32)
    for turn in range(size) if len(full) else ():
        with np.errstate(over="ignore"):
            ranks = _rank(place - np.uint32(turn))
        out[full, turn] = np.minimum.reduceat(ranks, first[:-1][full])
    return out


def _bands(least: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(least), BANDS))
    for row in range(ROWS):
        keys = mix(keys ^ least[:, row::ROWS]) + np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def _contents(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One value of each set, the same for equal sets."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes))])
        return mix(mix(sums[first[1:]] - sums[first[:-1]]) + np.diff(first).astype(np.uint64)).view(np.int64)


def _described(shingle: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()),
                        batch.column("text").to_pylist())
            for keys, texts in together(pairs):
                hashes, first = sets_of(texts, shingle)
                bands = _bands(signatures(hashes, first, BANDS * ROWS))
                yield pa.RecordBatch.from_arrays([
                    pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.array(_contents(hashes, first)), pa.array(np.diff(first)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))],
                    names=["doc_id", "digest", "content", "n", "bands"])

    return rows


def _listed(shingle: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in together(zip(batch.column("content").to_pylist(), batch.column("text").to_pylist())):
                hashes, first = sets_of(texts, shingle)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(
                    [hashes[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=["content", "shingles"])

    return rows


def _similar(shared, one, other, percent: int):
    return 100 * shared >= percent * (one + other - shared)


def _same_size(one: str, other: str, percent: int):
    """Sets of which the smaller has at least ``percent`` of the larger one's size; others cannot be similar enough."""
    return 100 * F.least(one, other) >= percent * F.greatest(one, other)


def _confirmed(percent: int):
    @F.arrow_udf(BooleanType())
    def near(one: pa.Array, other: pa.Array) -> pa.Array:
        found = []
        for a, b in zip(one, other):
            a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            found.append(bool(_similar(int((b[at] == a).sum()), len(a), len(b), percent)))
        return pa.array(found, pa.bool_())

    return near


def links_in_run(labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (indexes) between sets of different ``labels`` that connect whatever pairs of similar sets connect. Rows of
    one side (if not negative) are left to another cell. A set is not compared with those it is connected with by then."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    labels, found = labels.copy(), []
    for k in range(len(sets) - 1):
        open_ = (labels != labels[k]) & ((sides < 0) | (sides != sides[k])) & (
            100 * np.minimum(sizes, sizes[k]) >= percent * np.maximum(sizes, sizes[k]))
        open_[:k] = False
        if not open_.any():
            continue
        rest = flat[first[k + 1]:]
        at = np.minimum(np.searchsorted(sets[k], rest), sizes[k] - 1)
        shared = np.bincount(owner[first[k + 1]:][sets[k][at] == rest], minlength=len(sets))
        for j in np.flatnonzero(open_ & _similar(shared, sizes, sizes[k], percent)):
            found.append((k, int(j)))
            labels[labels == labels[j]] = labels[k]
    return found


def _compare(percent: int):
    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition sorted by key; holds a batch and one run."""
        key, run = None, []

        def found():
            contents, roots, sides, sets = zip(*run)
            pairs = links_in_run(np.unique(roots, return_inverse=True)[1], np.array(sides), sets, percent)
            return pa.RecordBatch.from_arrays([pa.array([contents[p[side]] for p in pairs], pa.int64()) for side in (0, 1)],
                                              names=["u", "v"])

        for batch in batches:
            for k, content, root, side, data in zip(*(batch.column(c).to_pylist() for c in (
                    "key", "content", "root", "side", "shingles"))):
                if k != key:
                    if len(run) > 1:
                        yield found()
                    key, run = k, []
                run.append((content, root, side, np.frombuffer(data, np.uint64)))
        if len(run) > 1:
            yield found()

    return links


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    roots = connected_components(links).withColumnRenamed("u", "content")
    return nodes.join(roots, "content", "left").withColumn("root", F.coalesce("root", "content"))


def _links_with_leaders(filed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``(u, v)`` between each text of a file and the file's leader."""
    asked = filed.where("content != leader.content").where(_same_size("n", "leader.n", percent)).select(
        F.col("content").alias("u"), F.col("leader.content").alias("v")).distinct()
    one = sets.select(F.col("content").alias("u"), F.col("shingles").alias("one"))
    other = sets.select(F.col("content").alias("v"), F.col("shingles").alias("other"))
    return asked.join(one, "u").join(other, "v").where(_confirmed(percent)("one", "other")).select("u", "v")


def _links_in_open_files(filed: DataFrame, rooted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between texts of files whose texts, the leader aside, are not connected yet. Files of the same
    texts are compared once."""
    rows = filed.where("content != leader.content").join(rooted.select("content", "root"), "content")
    open_ = rows.groupBy("file").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("total"),
        F.min(F.struct("n", "content")).alias("least"), F.max(F.struct("n", "content")).alias("most"),
        F.count(F.lit(1)).alias("texts"), F.sum(F.xxhash64("content").cast("decimal(38,0)")).alias("all"))
    once = open_.where("low != high").groupBy("texts", "total", "least", "most", "all").agg(F.min("file").alias("file"))
    dealt = rows.select("file", "content", "root").join(once.select(
        "file", F.greatest(F.ceil(F.col("total") / PART), F.lit(1)).cast("int").alias("parts")), "file").withColumn(
        "part", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int"))
    cells = dealt.select("content", "root", "part", "file", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "content", "root", F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).alias("side"),
        F.xxhash64("file", F.least("part", "other"), F.greatest("part", "other")).alias("key"))
    return cells.join(sets, "content").repartition("key").sortWithinPartitions("key").mapInArrow(
        _compare(percent), "u bigint, v bigint")


def near_copies(docs: DataFrame, id_col="doc_id", text_col="text", shingle=SHINGLE, percent=PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row of ``docs``: how many distinct shingles of ``shingle`` words
    (A-Z in lower case) its text has, and the smallest id that it reaches over pairs of texts that share at least
    ``percent`` of all their shingles, its own included.

    A text without words, null included, is linked with nothing. A row without an id takes part like any other but
    names no component (null if nothing in reach has an id). Repeated rows come out repeated. Of rows with one id and
    different texts each is linked by its own text. Other columns are not read.
    """
    texts = texts_of(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("digest"))
    with shuffles_end_with_jobs(docs.sparkSession):
        marked = cut_lineage(texts.mapInArrow(
            _described(shingle), "doc_id bigint, digest bigint, content bigint, n bigint, bands array<bigint>"), "circulant")
        nodes = cut_lineage(marked.where("n > 0").groupBy("content").agg(
            F.min("doc_id").alias("first_id"), F.min("digest").alias("digest"), F.first("n").alias("n"),
            F.first("bands").alias("bands")), "circulant-nodes")
        each = nodes.select("content", "n", F.explode("bands").alias("file"))
        shared = each.groupBy("file").agg(F.max(F.struct("n", "content")).alias("leader"), F.count(F.lit(1)).alias("texts"))
        filed = cut_lineage(each.join(shared.where("texts > 1").select("file", "leader"), "file"), "circulant-files")
        asked = filed.select("content").distinct().join(nodes, "content").select("content", "digest")
        one = texts.select("digest", "text").join(asked, "digest").groupBy("content").agg(F.first("text").alias("text"))
        sets = cut_lineage(one.mapInArrow(_listed(shingle), "content bigint, shingles binary"), "circulant-sets")
        links = cut_lineage(_links_with_leaders(filed, sets, percent), "circulant-links")
        rooted = cut_lineage(_rooted(nodes.select("content", "first_id"), links), "circulant-roots")
        more = _links_in_open_files(filed, rooted, sets, percent)
        rooted = _rooted(nodes.select("content", "first_id"), cut_lineage(links.unionByName(more), "circulant-all-links"))
        lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
        named = cut_lineage(rooted.join(lowest, "root").select("content", "component_id"), "circulant-components")
    empty = F.col("n") == 0
    return marked.select("doc_id", "content", "n").join(named, "content", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: The digest of ``near_copies`` with shingles of two words in DuckDB's SQL: pairs that share one of their rarest shingles, as similar pairs must,
#: are compared whole; then the smallest id in reach.
SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
    ELSE list_distinct(list_transform(list_zip(words[:len(words) - 1], words[2:]), lambda p: p[1] || ' ' || p[2])) END AS s
  FROM w),
kinds AS MATERIALIZED (SELECT list_sort(s) AS s, min(doc_id) AS d FROM sets WHERE len(s) > 0 GROUP BY ALL),
items AS MATERIALIZED (SELECT d, len(s) AS n, unnest(list_transform(s, lambda x: hash(x))) AS k FROM kinds),
common AS (SELECT k, count(*) AS f FROM items GROUP BY k),
rare AS MATERIALIZED (
  SELECT d, n, k FROM items JOIN common USING (k)
  QUALIFY row_number() OVER (PARTITION BY d ORDER BY f, k) <= n - (n * {PERCENT} + 99) // 100 + 1),
asked AS (
  SELECT DISTINCT a.d AS u, b.d AS v, a.n AS m, b.n AS n FROM rare a JOIN rare b ON a.k = b.k AND a.d < b.d
    AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
shared AS (
  SELECT u, v, any_value(m) AS m, any_value(asked.n) AS n, count(*) AS c
  FROM asked JOIN items a ON a.d = u JOIN items b ON b.d = v AND b.k = a.k GROUP BY u, v),
links AS MATERIALIZED (SELECT u, v FROM shared WHERE 100 * c >= {PERCENT} * (m + n - c)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT d, d AS r FROM kinds UNION SELECT reach.d, ways.v FROM reach JOIN ways ON reach.r = ways.u),
roots AS (SELECT d, min(r) AS root FROM reach GROUP BY d)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id,
  doc_id = coalesce(root, doc_id) AS kept
FROM sets LEFT JOIN kinds ON list_sort(sets.s) = kinds.s LEFT JOIN roots USING (d)
"""
