"""Removal of word sequences that stand earlier in the corpus, by compaction of a de Bruijn graph.

The graph's edges are windows of ``WINDOW`` consecutive words; each leads from its first words to its last. Consecutive
edges of a document whose smallest ``ANCHOR``-word hash is the same one form a path, about six edges long. A path is
known by its anchor and by the hash of all its words. The graph is compacted in joins:

1. anchors that occur once have no repeated edge, and their paths leave the graph;
2. equal paths become one, with the coordinates of their earliest source: all edges of the others are repeats;
3. where an anchor has one path only, nothing branches and nothing is left to ask. Where it has several, the earliest
   source of each is opened into single edges, and these are compared by their own earliest sources.

What was found comes back as spans with coordinates and hash. A span counts only if the words there have that hash.
No step ships all windows: the first moves an anchor's hash, the second a row a path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from kmerweave.llm.common import batch_texts, cut_lineage, fresh, shuffles_end_with_jobs
from kmerweave.llm.hashing import Runs, mix, together, word_hashes

WINDOW, ANCHOR = 20, 10
#: Rows without an id count as one document after all others.
NO_ID = (1 << 63) - 1

_PATHS = "anchor bigint, path bigint, doc bigint, start int, edges int"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    batch_texts(docs.sparkSession)
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"))


def _anchors(words: np.ndarray, first: np.ndarray) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows inside texts, in order: hashes of runs, window starts, texts, anchor positions, anchor hashes."""
    runs = Runs(words)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.arange(max(0, len(words) - WINDOW + 1))
    starts = starts[owner[starts] == owner[starts + WINDOW - 1]]
    at = np.arange(len(words) - ANCHOR + 1)
    grams = mix(runs.hash(at, at + ANCHOR) ^ np.uint64(0x5851F42D4C957F2D))
    choices = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - ANCHOR + 1)
    chosen = starts + choices[starts].argmin(axis=1)
    return runs, starts, owner[starts], chosen, grams[chosen]


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist())
        for docs, texts in together(rows):
            words, first = word_hashes(texts)
            if len(words) < WINDOW:
                continue
            runs, starts, owner, chosen, anchors = _anchors(words, first)
            if not len(starts):
                continue
            head = np.flatnonzero(np.concatenate([[True], np.diff(chosen) != 0]))
            edges = np.diff(np.append(head, len(starts)))
            at = starts[head]
            yield pa.RecordBatch.from_arrays([
                pa.array(anchors[head].view(np.int64)),
                pa.array(runs.hash(at, at + edges + WINDOW - 1).view(np.int64)),
                pa.array(np.array(docs, np.int64)[owner[head]]),
                pa.array((at - first[owner[head]]).astype(np.int32)),
                pa.array(edges.astype(np.int32))], names=["anchor", "path", "doc", "start", "edges"])


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single edges of the paths listed with each text, where the words there have the path's hash."""
    for batch in batches:
        anchors, paths, docs, starts = [], [], [], []
        for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "spans"))):
            runs, at, edges, anchor = _checked(text, spans)
            each = np.repeat(at, edges) + _counting(edges)
            anchors.append(np.repeat(anchor, edges))
            paths.append(runs.hash(each, each + WINDOW).view(np.int64))
            docs.append(np.full(len(each), doc, np.int64))
            starts.append(each.astype(np.int32))
        if docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (anchors, paths, docs, starts)],
                names=["anchor", "path", "doc", "start"])


def _counting(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one after another."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _checked(text: bytes, spans: list[dict]):
    words, _ = word_hashes([text])
    runs = Runs(words)
    start, edges = (np.array([s[k] for s in spans], np.int64) for k in ("start", "edges"))
    path, anchor = (np.array([s[k] for s in spans], np.int64) for k in ("path", "anchor"))
    inside = start + edges + WINDOW - 1 <= len(words)
    start, edges, path, anchor = (x[inside] for x in (start, edges, path, anchor))
    same = runs.hash(start, start + edges + WINDOW - 1).view(np.int64) == path
    return runs, start[same], edges[same], anchor[same]


@F.arrow_udf(StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()),
                         StructField("kept", BinaryType())]))
def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Takes the words of the listed spans out of each text."""
    total, gone, kept = [], [], []
    for data, found in zip(text.to_pylist(), spans.to_pylist()):
        words = data.split()
        covered = np.zeros(len(words) + 1, np.int64)
        if found:
            _, start, edges, _ = _checked(data, found)
            np.add.at(covered, start, 1)
            np.add.at(covered, start + edges + WINDOW - 1, -1)
        covered = np.cumsum(covered)[:len(words)] > 0
        total.append(len(words))
        gone.append(int(covered.sum()))
        kept.append(b" ".join([w for w, out in zip(words, covered) if not out] if gone[-1] else words))
    return pa.StructArray.from_arrays(
        [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
        names=["n_words", "n_removed", "kept"])


def _spans_by_doc(spans: DataFrame) -> DataFrame:
    """A document's spans in one row, which is no longer than the document."""
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "edges", "path", "anchor")).alias("spans"))


def _repeats(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Distinct ``(anchor, path)`` with their earliest source, and the rows of ``rows`` that are not it."""
    sources = cut_lineage(rows.groupBy("anchor", "path").agg(
        F.min(F.struct("doc", "start")).alias("source"), F.first("edges").alias("edges"),
        F.count(F.lit(1)).alias("n")), label)
    repeated = sources.where("n > 1").select("anchor", "path", "source")
    later = rows.join(repeated, ["anchor", "path"]).where(
        F.struct("doc", "start") != F.col("source")).select("doc", "start", "edges", "path", "anchor")
    return sources, later


def repeated_spans(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Spans ``(doc, start, edges, path, anchor)`` whose ``edges`` windows from word ``start`` on all stand earlier,
    by id and then by position. Together they cover every such window."""
    rows = _keyed(docs, id_col, text_col)
    paths = rows.mapInArrow(_paths, _PATHS)
    shared = cut_lineage(paths.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"),
                         "anchors")
    graph = cut_lineage(paths.join(shared, "anchor"), "paths")
    sources, later = _repeats(graph, "path-sources")
    branching = cut_lineage(sources.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "anchor"), "branching")
    opened = sources.join(branching, "anchor").select("source.doc", "source.start", "edges", "path", "anchor")
    listed = rows.join(cut_lineage(_spans_by_doc(opened), "opened"), "doc")
    edges = cut_lineage(listed.mapInArrow(_edges, "anchor bigint, path bigint, doc bigint, start int").withColumn(
        "edges", F.lit(1)), "edges")
    _, later_edges = _repeats(edges, "edge-sources")
    return later.unionByName(later_edges)


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", out_col="cut") -> DataFrame:
    """``docs`` with the struct ``out_col`` (in place of a column of that name): ``n_words``, ``n_removed``, the words
    that a window of ``WINDOW`` words covers that starts earlier (in a document with a smaller id, or earlier in the
    same one), and ``kept``, the others joined by one space, as UTF-8 bytes.

    Windows are judged on the input. A null text is empty. Rows without an id count as one document after all others.
    Rows that repeat an id are that document again: a window is no repeat of itself.
    """
    with shuffles_end_with_jobs(docs.sparkSession):
        found = cut_lineage(_spans_by_doc(repeated_spans(docs, id_col, text_col)), "spans")
    key, spans = fresh(docs, "span_doc"), fresh(docs, "spans")
    found = found.select(F.col("doc").alias(key), F.col("spans").alias(spans))
    keyed = docs.withColumn(key, F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))).join(found, key, "left")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return keyed.withColumn(out_col, _cut(text, F.col(spans))).drop(key, spans)


def drop_repeats(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with repeated passages taken out of the texts: what is left is joined by single spaces. Texts without
    one, null included, stay as they are."""
    out = fresh(docs, "cut")
    cut = remove_repeats(docs, id_col, text_col, out)
    text = F.when(F.col(f"{out}.n_removed") > 0, F.col(f"{out}.kept").cast("string")).otherwise(F.col(text_col))
    return cut.withColumn(text_col, text).select(*docs.columns)


#: The digest of ``remove_repeats`` in DuckDB's SQL, window by window.
SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, s, array_to_string(words[s:s + {WINDOW - 1}], ' ') AS k
  FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS u(s)),
first_at AS (SELECT k, min(struct_pack(d := doc_id, s := s)) AS f FROM windows GROUP BY k HAVING count(*) > 1),
later AS (SELECT doc_id, s FROM windows JOIN first_at USING (k) WHERE doc_id <> f.d OR windows.s <> f.s),
gone AS (SELECT doc_id, list(DISTINCT s + j) AS spots FROM later, unnest(range({WINDOW})) AS v(j) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(spots), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN spots IS NULL THEN words
    ELSE list_filter(words, lambda x, i: NOT list_contains(spots, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
