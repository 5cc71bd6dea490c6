"""Indexing sequences as they arrive, each distinct content once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from kmerweave.operators.kmers import kmer_scan, not_yet_indexed
from kmerweave.sources.cache import not_there


def index_stream(seqs: DataFrame, path: str, checkpoint: str, alphabet, wordlen, mask=(), trigger=None):
    """Starts a query that adds the words of new contents of a stream of
    ``(seq_id, seq)`` to the index at ``path`` (``contents`` and ``kmers``).

    Every micro-batch owns one directory that it overwrites, so a batch that runs
    again after a failure leaves no duplicates; contents of earlier batches are
    removed by an anti-join.
    """
    spark = seqs.sparkSession

    def add(batch: DataFrame, batch_id: int):
        try:
            seen = spark.read.parquet(f"{path}/contents").where(f"batch < {batch_id}")
        except AnalysisException as error:
            if not not_there(error):
                raise
            seen = spark.createDataFrame([], "content_id string")
        new = not_yet_indexed(batch, seen).select("content_id", "seq_id", "seq").persist()
        try:
            kmer_scan(new, alphabet, wordlen, mask).write.mode("overwrite").parquet(f"{path}/kmers/batch={batch_id}")
            new.select("content_id", "seq_id").write.mode("overwrite").parquet(f"{path}/contents/batch={batch_id}")
        finally:
            new.unpersist()

    writer = seqs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_index(spark, path: str) -> DataFrame:
    """Words indexed so far: ``(seq_id, pos, kmer)``."""
    return spark.read.parquet(f"{path}/kmers").select("seq_id", "pos", "kmer")
