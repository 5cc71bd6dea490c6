"""Alignment files: SAM records, MAF and Clustal blocks, tabular hits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kmerweave.operators.lineage import cut_lineage
from kmerweave.sources.fasta import _records, write_parts

COLUMNS_PER_TILE = 4096
#: Equal columns that leave Python together.
COLUMNS_TOGETHER = 1 << 16


# -- SAM ---------------------------------------------------------------------

def cigar_to_opseq(cigar):
    """Edit string of a CIGAR of ``M I D`` operations, without flanking gaps; other
    operations fail the job. ``M`` is not told apart into match and mismatch."""
    cigar = F.col(cigar) if isinstance(cigar, str) else cigar
    valid = F.regexp_replace(cigar, r"\d+[MID]", "") == ""
    steps = F.regexp_extract_all(cigar, F.lit(r"(\d+[MID])"), F.lit(1))
    steps = F.when(F.element_at(steps, 1).rlike("[ID]$"), F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0)))).otherwise(steps)
    steps = F.when(F.try_element_at(steps, F.lit(-1)).rlike("[ID]$"), F.slice(steps, F.lit(1), F.size(steps) - 1)).otherwise(steps)
    ops = F.array_join(F.transform(steps, lambda s: F.repeat(
        F.right(s, F.lit(1)), F.left(s, F.length(s) - 1).cast("int"))), "")
    return F.when(valid, ops).otherwise(F.raise_error(F.concat(F.lit("unsupported CIGAR: "), cigar)))


def read_sam(spark, path) -> DataFrame:
    """Mapped records of SAM text: ``(qname, rname, pos, cigar, seq, opseq)``."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    f = lines.select(F.split("value", "\t").alias("f"))
    rec = f.select(F.get("f", F.lit(0)).alias("qname"), F.get("f", F.lit(2)).alias("rname"),
                   F.get("f", F.lit(3)).cast("int").alias("pos"), F.get("f", F.lit(5)).alias("cigar"),
                   F.get("f", F.lit(9)).alias("seq")).where("cigar <> '*'")
    return rec.withColumn("opseq", cigar_to_opseq("cigar"))


def write_opseqs(opseqs: DataFrame, path, mode="errorifexists"):
    opseqs.select(F.col("opseq").alias("value")).write.mode(mode).text(path)


# -- multiple alignments -----------------------------------------------------

def read_blocks(spark, path, fmt="maf") -> DataFrame:
    """Aligned rows of all blocks: ``(file, block, row, id, aligned)`` with ``block``
    the byte offset and ``row`` the order inside a block."""
    if fmt == "maf":
        pattern, text = r"^s\s+(\S+)\s+\d+\s+\d+\s+[+-]\s+\d+\s+(\S+)", 2
    elif fmt == "clustal":
        pattern, text = r"^(?!CLUSTAL)(\S+)\s+([A-Za-z-]+)(?:\s+\d+)?\s*$", 2
    else:
        raise ValueError(f"unknown format: {fmt}")
    lines = _records(spark, path, "\n\n").select(
        "file", F.col("offset").alias("block"), F.posexplode(F.split("value", "\n")).alias("row", "line"))
    return lines.where(F.col("line").rlike(pattern)).select(
        "file", "block", "row", F.regexp_extract("line", pattern, 1).alias("id"),
        F.regexp_extract("line", pattern, text).alias("aligned"))


def _parts(df, keys, part) -> DataFrame:
    """Parts of each group's sequence with the offset at which they start; a part per block."""
    sized = df.withColumn("_n", F.length(part))
    return _upto(sized, keys, "_n", "start").drop("_n")


def sequences(blocks: DataFrame) -> DataFrame:
    """Ungapped sequence of every id, in parts: ``(id, file, block, start, seq)`` with ``start`` the letters in the
    blocks before. Parts of any length add up without ever being in one place."""
    return _parts(blocks.withColumn("seq", F.replace("aligned", F.lit("-"), F.lit(""))), ["id"], "seq").select(
        "id", "file", "block", "start", "seq")


def _op(x, y):
    """Operation of one column of two aligned rows, NULL for a double gap; two
    unknown bases do not match."""
    return (F.when((x == "-") & (y == "-"), F.lit(None).cast("string"))
            .when(x == "-", F.lit("I")).when(y == "-", F.lit("D"))
            .when((x == y) & (x != "N"), F.lit("M")).otherwise(F.lit("S")))


def pairwise(blocks: DataFrame) -> DataFrame:
    """Edit transcripts of all pairs of ids that share a block, over all blocks, in parts:
    ``(id1, id2, file, block, start, opseq)`` with ``start`` the operations in the blocks before. The id that appears
    first is the origin. A row missing from a block counts as all gaps; a block in which both are missing has no part.

    Blocks are joined with themselves on the block.
    """
    blocks = cut_lineage(blocks, "blocks")
    ranks = blocks.groupBy("id").agg(F.min(F.struct("file", "block", "row")).alias("rank"))
    ranked = blocks.select("file", "block", "id").join(ranks, "id")
    pairs = ranked.withColumnsRenamed({"id": "id1", "rank": "r1"}).join(
        ranked.withColumnsRenamed({"id": "id2", "rank": "r2"}), ["file", "block"]).where("r1 < r2").select(
        "id1", "id2").distinct()
    known = blocks.select(
        "file", "block", "id", F.regexp_extract_all("aligned", F.lit("(.)"), F.lit(1)).alias("c"))
    sizes = known.groupBy("file", "block").agg(F.max(F.size("c")).alias("n"))
    left = known.select("file", "block", F.col("id").alias("id1"), F.col("c").alias("c1"))
    right = known.select("file", "block", F.col("id").alias("id2"), F.col("c").alias("c2"))
    # Pieces in which at least one of the two ids has a row.
    one = left.join(pairs, "id1").join(right, ["file", "block", "id2"], "left")
    lone = right.join(pairs, "id2").join(left, ["file", "block", "id1"], "left_anti").withColumn(
        "c1", F.lit(None).cast("array<string>"))
    cols = ["file", "block", "id1", "id2", "c1", "c2"]
    both = one.select(*cols).unionByName(lone.select(*cols)).join(sizes, ["file", "block"])
    gaps = F.array_repeat(F.lit("-"), F.col("n"))
    ops = F.array_join(F.zip_with(F.coalesce("c1", gaps), F.coalesce("c2", gaps), _op), "")
    return _parts(both.withColumn("opseq", ops), ["id1", "id2"], "opseq").select(
        "id1", "id2", "file", "block", "start", "opseq")


def _upto(df, keys, value, out):
    """Sum of a value over the blocks before each row, per key: running sums inside
    each file, shifted by the totals of the files before it."""
    inside = Window.partitionBy(*keys, "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "file").agg(F.sum(value).alias("_total"))
    files = Window.partitionBy(*keys) if keys else Window.partitionBy()
    ahead = F.sum("_total").over(files.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    shifts = totals.withColumn("_shift", F.coalesce(ahead, F.lit(0))).drop("_total")
    return df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(
        shifts, [*keys, "file"]).withColumn(out, F.col("_in") + F.col("_shift")).drop("_in", "_shift")


def _equal_columns(n_ids):
    """Of each block, the columns that ``n_ids`` rows have and in which these are equal, with the rows' letters so far."""
    def columns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in zip(*batch.columns):
                rows = sorted(rows.as_py(), key=lambda r: (r["id"], r["base"]))
                letters = [np.frombuffer(r["aligned"].encode("utf-32-le"), np.uint32) for r in rows]
                upto = [r["base"] + np.cumsum(x != ord("-")) for r, x in zip(rows, letters)]
                size = max(map(len, letters))
                n, low, high = np.zeros(size, np.int64), np.full(size, 1 << 32), np.full(size, -1)
                for x in letters:
                    n[:len(x)] += 1
                    low[:len(x)], high[:len(x)] = np.minimum(low[:len(x)], x), np.maximum(high[:len(x)], x)
                found = np.flatnonzero((n == n_ids) & (low == high))
                for at in (found[k:k + COLUMNS_TOGETHER] for k in range(0, len(found), COLUMNS_TOGETHER)):
                    there = np.stack([at < len(x) for x in letters], axis=1)
                    positions = np.stack([u[np.minimum(at, len(u) - 1)] if len(u) else at for u in upto], axis=1)[there]
                    ends = np.arange(len(at) + 1, dtype=np.int32) * n_ids
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(first.as_py() + at, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(positions, pa.int64()))],
                        names=["col", "positions"])

    return columns


def exact_seeds(blocks: DataFrame, wordlen: int, ids=None) -> DataFrame:
    """Columns at which ``wordlen`` consecutive columns are equal in all rows:
    ``(col, positions)`` with the number of letters each id has seen up to and
    including the column, in id order. Letters are compared upper-cased, and ids
    missing from a block count as gaps there.

    Columns are numbered over all blocks; a block's rows are compared where they lie,
    and runs of equal columns are counted in tiles that overlap by a word.
    """
    if ids is not None:
        blocks = blocks.where(F.col("id").isin(*ids))
    blocks = cut_lineage(blocks.withColumn("aligned", F.upper("aligned")), "blocks")
    n_ids = blocks.select("id").distinct().count()
    shape = _upto(blocks.groupBy("file", "block").agg(F.max(F.length("aligned")).alias("n")), [], "n", "first_col")
    total = shape.agg(F.sum("n")).first()[0] or 0
    bases = _upto(blocks.select("file", "block", "id", F.length(F.replace("aligned", F.lit("-"), F.lit(""))).alias("k")),
                  ["id"], "k", "base").drop("k")
    rows = blocks.join(shape.drop("n"), ["file", "block"]).join(bases, ["file", "block", "id"])
    whole = rows.groupBy("file", "block", "first_col").agg(F.collect_list(F.struct("id", "base", "aligned")).alias("rows"))
    good = whole.where(F.size("rows") >= n_ids).select("first_col", "rows").mapInArrow(
        _equal_columns(n_ids), "col bigint, positions array<bigint>")
    tiled = good.withColumn("tile", F.explode(F.sequence(
        F.floor((F.col("col") - wordlen + 1) / COLUMNS_PER_TILE), F.floor(F.col("col") / COLUMNS_PER_TILE))))
    ahead = Window.partitionBy("tile").orderBy("col").rangeBetween(0, wordlen - 1)
    return tiled.withColumn("run", F.count(F.lit(1)).over(ahead)).where(
        (F.col("run") == wordlen) & (F.col("tile") == F.floor(F.col("col") / COLUMNS_PER_TILE))
        & (F.col("col") <= total - wordlen)).select("col", "positions")


def write_individual(blocks: DataFrame, path, mode="errorifexists"):
    """Ungapped sequences as FASTA, written in parts."""
    write_parts(sequences(blocks), path, name="id", mode=mode)


def write_pairwise(blocks: DataFrame, path, mode="errorifexists"):
    """Pairwise transcripts as FASTA records named ``id1:id2``, written in parts."""
    write_parts(pairwise(blocks).withColumn("name", F.concat_ws(":", "id1", "id2")), path, part="opseq", mode=mode)


def maf_text(rows: DataFrame, block="block", order="row", name="id", aligned="aligned") -> DataFrame:
    """MAF paragraphs, one row per block, from a table of aligned rows; a block has
    as many lines as there are aligned sequences."""
    size = F.length(F.replace(F.col(aligned), F.lit("-"), F.lit("")))
    line = F.concat_ws(" ", F.lit("s"), F.col(name), F.lit("0"), size, F.lit("+"), size, F.col(aligned))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return rows.groupBy(block).agg(F.concat(
        F.lit("a\n"), F.array_join(F.transform(lines, lambda x: x["l"]), "\n"), F.lit("\n")).alias("value"))


# -- tabular hits ------------------------------------------------------------

def read_hits(spark, path) -> DataFrame:
    """Whitespace-separated hits ``type read gene percent matches/length``."""
    f = spark.read.text(path).where("value <> ''").select(F.split(F.trim("value"), r"\s+").alias("f"))
    part = F.split(F.get("f", F.lit(4)), "/")
    return f.select(F.get("f", F.lit(0)).alias("gene_type"), F.get("f", F.lit(1)).alias("read"),
                    F.get("f", F.lit(2)).alias("gene"), (F.get("f", F.lit(3)).cast("double") / 100).alias("p"),
                    F.get(part, F.lit(0)).cast("int").alias("num_matches"), F.get(part, F.lit(1)).cast("int").alias("length"))
