"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kmerweave.operators.lineage import cut_lineage, scratch_path  # noqa: F401  (re-exported for the operators)

#: A word is a run of anything but ASCII space, tab, line feed, vertical tab, form feed and carriage return. That is
#: what ``bytes.split()`` yields on UTF-8; this is the same rule as a pattern for SQL functions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    while name in df.columns:
        name += "_"
    return name


def batch_texts(spark: SparkSession) -> None:
    """Texts are long rows: Arrow batches of the default 10,000 rows would hold tens of megabytes several times over in
    each task. The setting stays, as a result is computed after its operator has returned; another value is respected."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, "1000")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only what text operators read: ``(doc_id, text)`` with the text as UTF-8 bytes, null as empty."""
    batch_texts(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"))


def one_row_per_id(docs: DataFrame, id_col: str) -> DataFrame:
    """One row of each id. Rows without an id all stay, as nothing says that they are the same document. Costs no
    shuffle where ``docs`` is already partitioned by id."""
    rank = fresh(docs, "copy_number")
    named = docs.where(docs[id_col].isNotNull())
    first = named.withColumn(rank, F.row_number().over(Window.partitionBy(id_col).orderBy(F.lit(1)))).where(
        F.col(rank) == 1).drop(rank)
    return first.unionByName(docs.where(docs[id_col].isNull()))


def bucket_of(id_col: str, of: int):
    """The remainder of the checksum of an id as text; -1 for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of, F.lit(-1))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffles_end_with_jobs(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query ends, not when the driver happens to collect its garbage.
    For chains of jobs whose results are written tables, so that nothing reads an earlier job's shuffle again."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
