"""The named queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from kmerweave.llm import (
    byte_bpe, circulant, collocations, lm_score, mixing, neighbours, quality, simhash, spelling, substrings, token_files,
    toxicity, url_filter)
from kmerweave.llm.common import bucket_of, table


def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_quality(spark, sf_dir):
    found = quality.judged(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & (F.col("p_good") >= 0.5)).alias("kept"), "p_good")


def op3_substrings(spark, sf_dir):
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "cut.n_words", "cut.n_removed", F.sha2("cut.kept", 256).alias("kept_sha256"))


def op4_token_files(spark, sf_dir):
    with open(public_tokenizers.path("byte_bpe_50k.json")) as file:
        read = token_files.round_trip(table(spark, sf_dir, "documents"), file.read())
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return read.select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_mixing(spark, sf_dir):
    sized = mixing.sizes(table(spark, sf_dir, "documents"))
    found = mixing.summed(mixing.curriculum(sized, size_col="size", mix_col="mix"))
    at = [F.round(c, 9).alias(c) for c in ("first_position", "last_position")]
    return found.select("doc_id", "size", "source_size", "target", "taken", *at)


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_byte_bpe(spark, sf_dir):
    ranks = byte_bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, form="bytes")
    decoded = byte_bpe.decode(encoded, ranks)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op9_lm_score(spark, sf_dir):
    held_out = bucket_of("doc_id", 7) == 2
    found = lm_score.scores(table(spark, sf_dir, "documents"), held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]


def op10_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select(
        "page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op11_circulant(spark, sf_dir):
    found = circulant.near_copies(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_quality, op3_substrings, op4_token_files, op5_neighbours, op6_mixing, op7_toxicity, op8_byte_bpe,
    op9_lm_score, op10_url_filter, op11_circulant, op12_collocations, op13_spelling)}
SQL: dict[str, str] = {"op3_substrings": substrings.SQL, "op6_mixing": mixing.SQL, "op10_url_filter": url_filter.sql(URL_RULES),
                       "op11_circulant": circulant.SQL, "op12_collocations": collocations.SQL, "op13_spelling": spelling.SQL}
