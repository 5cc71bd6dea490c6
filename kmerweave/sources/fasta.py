"""FASTA-like files: sequences, mapped reads, edit transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kmerweave.functions.transcripts import remove_long_gaps
from kmerweave.operators.lineage import cut_lineage

#: Letters of a line of records that are written in parts.
LINE = 1 << 12
# A record ends where a line starts with ">".
SEPARATOR = "\n>"


def _records(spark, path, separator) -> DataFrame:
    """Raw records of text files with their byte offsets.

    Offsets are running sums of record sizes inside each input split, shifted by
    the sizes of the splits before it, so no file is read by one task.
    """
    raw = spark.read.option("lineSep", separator).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    raw = raw.withColumn("size", F.octet_length("value") + len(separator))
    blocks = raw.groupBy("file", "block").agg(F.sum("size").alias("total"))
    shift = F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", shift.alias("shift"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("file", "block").orderBy("row").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    return raw.withColumn("ahead", ahead).join(blocks, ["file", "block"]).select(
        "file", (F.col("shift") + F.col("ahead")).alias("offset"), "value")


def read_fasta(spark, path, num_seqs=-1) -> DataFrame:
    """``(file, pos, name, seq)``: ``pos`` is the byte offset of the header line.
    Bodies may span lines; records without letters are left out. A positive
    ``num_seqs`` keeps that many records, in file order."""
    rec = _records(spark, path, SEPARATOR)
    body = F.regexp_replace("value", "\\A>", "")
    name = F.trim(F.regexp_replace(F.substring_index(body, "\n", 1), "\r", ""))
    lines = F.when(F.instr(body, "\n") > 0, F.substring(body, F.instr(body, "\n") + 1, F.length(body))).otherwise(F.lit(""))
    out = rec.where(F.length(F.trim("value")) > 0).select(
        "file", F.when(F.col("offset") == 0, F.lit(0)).otherwise(F.col("offset") - 1).alias("pos"),
        name.alias("name"), F.regexp_replace(lines, "\\s", "").alias("seq")).where("seq <> ''")
    return out.orderBy("file", "pos").limit(num_seqs) if num_seqs > 0 else out


def write_fasta(seqs: DataFrame, path, name="name", seq="seq", mode="errorifexists"):
    """One record per row: ``> name`` and the sequence on one line."""
    seqs.select(F.concat(F.lit("> "), F.col(name).cast("string"), F.lit("\n"), F.col(seq)).alias("value")
                ).write.mode(mode).text(path)


def write_parts(parts: DataFrame, path, name="name", part="seq", start="start", mode="errorifexists"):
    """Records from parts of their sequences, a header in front of the part that starts at 0, in lines of up to
    ``LINE`` letters. Parts are dealt by ranges of name and start, so a long record is written by several tasks and goes
    over several files: in order of their names these are one FASTA file, and ``read_parts`` reads them as one. Records
    without letters are left out."""
    rows = cut_lineage(parts.where(F.col(part) != "").select(
        F.col(name).cast("string").alias("name"), F.col(start).cast("bigint").alias("start"), F.col(part).alias("part")), "fasta-parts")
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length("part") - 1) / LINE).cast("int")),
                                     lambda k: F.substring("part", k * LINE + 1, F.lit(LINE))), "\n")
    head = F.when(F.col("start") == 0, F.concat(F.lit("> "), F.col("name"), F.lit("\n"))).otherwise("")
    rows.repartitionByRange("name", "start").sortWithinPartitions("name", "start").select(
        F.concat(head, lines).alias("value")).write.mode(mode).text(path)


def _carried(lines: DataFrame, of: str) -> DataFrame:
    """``(file, block, carried)``: the sum of column ``of`` over all input splits of a file before each one. One row a split."""
    totals = lines.groupBy("file", "block").agg(F.sum(of).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("carried"))


def read_parts(spark, path) -> DataFrame:
    """Sequences in parts, a line each: ``(file, block, row, name, start, seq)``, ``start`` the letters of the record in the
    lines before. A record may be longer than an input split and may go on in the next file.

    A split knows the names and sums from its own headers on; what it lacks in front of the first comes from one row for each
    split before it.
    """
    raw = spark.read.text(path).select(
        F.regexp_replace("value", "\\s+$", "").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    head = F.col("value").startswith(">")
    lines = raw.select("file", "block", "row", F.when(head, F.trim(F.substring("value", F.lit(2), F.length("value")))).alias("head"),
                       F.when(head, F.lit("")).otherwise(F.regexp_replace("value", "\\s", "")).alias("seq"))
    split = Window.partitionBy("file", "block").orderBy("row")
    record = F.count("head").over(split.rowsBetween(Window.unboundedPreceding, 0))
    known = lines.withColumn("record", record).withColumn("name", F.last("head", True).over(split)).withColumn(
        "ahead", F.coalesce(F.sum(F.length("seq")).over(Window.partitionBy("file", "block", "record").orderBy("row").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    # Of each split the last record it knows and how many letters that has there; of one without a header, all letters.
    ends = known.groupBy("file", "block").agg(F.max(F.struct("row", "record", "name", (F.col("ahead") + F.length("seq")).alias("n"))).alias("last"))
    ordered = Window.orderBy("file", "block")
    chains = ends.select("file", "block", "last.*").withColumn(
        "chain", F.sum((F.col("record") > 0).cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("chain").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, 0)
    ready = chains.withColumn("begun", F.first("name").over(chain)).withColumn("letters", F.sum("n").over(chain)).select(
        "file", "block", F.lag("begun").over(ordered).alias("begun"), F.lag("letters").over(ordered).alias("letters"))
    joined = known.where("seq <> ''").join(ready, ["file", "block"])
    first = F.col("record") == 0
    return joined.select("file", "block", "row", F.when(first, F.col("begun")).otherwise(F.col("name")).alias("name"),
                         (F.col("ahead") + F.when(first, F.coalesce("letters", F.lit(0))).otherwise(0)).cast("bigint").alias("start"), "seq")


def read_mapped_reads(spark, path, max_num=-1) -> DataFrame:
    """Two-line records ``> strand from:to`` and bases:
    ``(file, pos, strand, map_from, map_to, seq)``."""
    out = read_fasta(spark, path, max_num)
    head = r"^([+-])\s+(\d+):(\d+)$"
    ok = F.col("name").rlike(head)
    strand = F.when(ok, F.regexp_extract("name", head, 1)).otherwise(
        F.raise_error(F.concat(F.lit("not a mapped read: "), F.col("name"))))
    return out.select("file", "pos", strand.alias("strand"),
                      F.regexp_extract("name", head, 2).cast("int").alias("map_from"),
                      F.regexp_extract("name", head, 3).cast("int").alias("map_to"), "seq")


def read_bases(spark, path) -> DataFrame:
    """Records of a genome file as one coordinate system, in parts: upper-cased, unknown bases ``N`` dropped,
    ``(file, block, row, name, start, seq)`` with ``start`` the letters in front of a part in its whole file. Sums run inside
    input splits and over one row for each split."""
    parts = read_parts(spark, path).withColumn("seq", F.replace(F.upper("seq"), F.lit("N"), F.lit("")))
    sized = parts.withColumn("n", F.length("seq"))
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("n").over(inside), F.lit(0))
    return sized.withColumn("start", ahead).join(_carried(sized, "n"), ["file", "block"]).select(
        "file", "block", "row", "name", (F.col("start") + F.col("carried")).alias("start"), "seq")


def clean_transcripts(transcripts: DataFrame, path, max_gap=100, name="name", tx="seq", mode="errorifexists"):
    """Writes transcripts without their long gaps, as FASTA."""
    write_fasta(transcripts.select(
        F.concat(F.lit(f"(cleaned, max_gap = {max_gap}) "), F.col(name).cast("string")).alias("name"),
        remove_long_gaps(tx, max_gap).alias("seq")), path, mode=mode)
