"""A training corpus in stages: each reads what the one before has kept and returns documents, the last one tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerweave.llm import byte_bpe, minhash, mixing, substrings, toxicity
from kmerweave.llm.common import cut_lineage, fresh, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay."""
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    score = fresh(docs, "score")
    return toxicity.score(docs, model, out_col=score).where(F.col(score) < 0.5).drop(score)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id: texts with a Jaccard similarity of
    five-word shingles of at least 0.8."""
    return minhash.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash fingerprints link, as in ``op1``, stays, the one with the smallest id; of these
    the ones that ``deduplicate`` keeps, so no two that stay are linked in either way."""
    return deduplicate(spark, cut_lineage(minhash.keep_first_linked(docs), "pipeline-fingerprints"), sf_dir)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 and more words stay only where they stand first; ``n_chars`` counts what is left."""
    return substrings.drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each time that the mix takes them, with their ``position`` in training."""
    return mixing.curriculum(docs, out_col="position")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the ``position`` in training, the token ids (little-endian unsigned 32-bit integers), how many these are,
    and the bytes of what they decode to."""
    ranks = byte_bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = byte_bpe.decode(byte_bpe.encode(
        docs, ranks, public_tokenizers.PATTERN, form="bytes", position_col="position", chunk_bytes=2 << 20), ranks)
    return decoded.select("doc_id", "position", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.octet_length("bytes").cast("long").alias("n_bytes"))


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_copies), ("repeated_passages", cut_repeats),
          ("mixing", mix_sources), ("tokens", tokenize)]

#: SQL cannot express fingerprints, learned scores or subword encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
