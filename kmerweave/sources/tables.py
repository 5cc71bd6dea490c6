"""Sequences derived from text tables.

The letters ``a c g t`` of a text, lower-cased and in order, form its sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Redistributes a table that arrives in fewer partitions than there are
    cores. Word scans multiply the data some twentyfold, so moving the raw text
    first is cheap; large inputs come in many splits and are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def as_sequence(text):
    return F.regexp_replace(F.lower(text), "[^acgt]", "")


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("doc_id").alias("seq_id"), as_sequence("text").alias("seq"))


def benchmark(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("seq_id"), as_sequence("text").alias("seq"))


def pages(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select(
        F.col("page_id").alias("seq_id"), as_sequence("html").alias("seq"))


def conversations(spark, sf_dir) -> DataFrame:
    """Turns as sequences, grouped by conversation."""
    return spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select(
        F.col("conv_id").alias("group_id"), F.col("turn").alias("ord"),
        as_sequence("text").alias("seq"))
