"""Words (k-mers): scanning, indexing, lookup and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kmerweave.functions.alphabet import Alphabet, content_id

MAX_WORD = 2 ** 63 - 1
# Letters scanned per step: bounds the array held for one row of a long sequence.
CHUNK = 8192
# Words of a bucket of a stored index.
WORDS = 1 << 23


def check_word_length(alphabet: Alphabet, wordlen: int):
    if wordlen < 1 or len(alphabet) > 36 or len(alphabet) ** wordlen > MAX_WORD:
        raise ValueError(f"{wordlen}-letter words over {len(alphabet)} letters do not fit 64 bits")


def _is_masked(word, alphabet, mask):
    """True where the *set* of digits of a word equals one of the mask sets."""
    digit = {i: d for i, d in enumerate("0123456789abcdefghijklmnopqrstuvwxyz")}
    hit = F.lit(False)
    for letters in mask:
        found = [digit[x if isinstance(x, int) else alphabet.letters.index(x)] for x in letters]
        only = F.length(F.translate(word, "".join(found), "")) == 0
        for x in found:
            only = only & (F.instr(word, x) > 0)
        hit = hit | only
    return hit


def kmer_scan(seqs: DataFrame, alphabet: Alphabet, wordlen: int, mask=(),
              keep_masked=False, id_cols=("seq_id",)) -> DataFrame:
    """All words of every sequence: ``(*id_cols, pos, kmer)``.

    Words are base-``n`` integers. Long sequences are first cut into chunks that
    overlap by ``wordlen - 1`` letters, each word is then a constant-time slice of
    the chunk's bytes, so the scan is linear and never holds a whole sequence's
    words. Masked words are dropped, or kept as NULL with ``keep_masked``.
    """
    check_word_length(alphabet, wordlen)
    ids = list(id_cols)
    coded = seqs.select(*ids, F.encode(alphabet.digits("seq"), "US-ASCII").alias("_b"))
    # ``sequence`` would run backwards for sequences shorter than a word.
    starts = F.when(F.length("_b") >= wordlen, F.sequence(
        F.lit(0), F.floor((F.length("_b") - wordlen) / CHUNK).cast("int"))).otherwise(
            F.array().cast("array<int>"))
    chunks = coded.select(*ids, F.explode(F.transform(
        starts,
        lambda c: F.struct(
            (c * CHUNK).alias("at"),
            F.substring("_b", c * CHUNK + 1, F.lit(CHUNK + wordlen - 1)).alias("part")))).alias("c"))
    words = chunks.select(*ids, "c.at", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.length("c.part") - wordlen + 1),
        lambda p: F.substring("c.part", p, F.lit(wordlen)))).alias("_p", "_w"))
    word = F.col("_w").cast("string")
    # Never NULL; saying so keeps joins from testing each word a second time.
    value = F.coalesce(F.conv(word, len(alphabet), 10).cast("bigint"), F.lit(0))
    if mask:
        value = F.when(~_is_masked(word, alphabet, mask), value)
    out = words.select(*ids, (F.col("at") + F.col("_p")).alias("pos"), value.alias("kmer"))
    return out if keep_masked or not mask else out.where("kmer IS NOT NULL")


def kmer_value(word, alphabet: Alphabet):
    """Integer of one word column."""
    return F.conv(alphabet.digits(word), len(alphabet), 10).cast("bigint")


def kmer_arrays(seqs: DataFrame, alphabet: Alphabet, wordlen: int, mask=()) -> DataFrame:
    """Word array of every distinct sequence, keyed by content, NULL where
    masked: ``(content_id, kmers)``; one row per content, so it serves as a
    cache table. The row is as long as its sequence."""
    check_word_length(alphabet, wordlen)
    distinct = seqs.select(content_id("seq").alias("content_id"), "seq").dropDuplicates(["content_id"])
    coded = distinct.select("content_id", F.encode(alphabet.digits("seq"), "US-ASCII").alias("_b"))

    def value(p):
        word = F.substring("_b", p, F.lit(wordlen)).cast("string")
        number = F.conv(word, len(alphabet), 10).cast("bigint")
        return F.when(~_is_masked(word, alphabet, mask), number) if mask else number

    empty = F.array().cast("array<bigint>")
    return coded.select("content_id", F.when(
        F.length("_b") >= wordlen,
        F.transform(F.sequence(F.lit(1), F.length("_b") - wordlen + 1), value)
    ).otherwise(empty).alias("kmers"))


def distinct_contents(seqs: DataFrame) -> DataFrame:
    """One row per distinct content; the smallest id stands for its copies."""
    return seqs.withColumn("content_id", content_id("seq")).groupBy("content_id").agg(
        F.min_by("seq", "seq_id").alias("seq"), F.min("seq_id").alias("seq_id"))


def kmer_index(seqs: DataFrame, alphabet: Alphabet, wordlen: int, mask=()) -> DataFrame:
    """Words of every distinct content, indexed once under its smallest id."""
    return kmer_scan(distinct_contents(seqs), alphabet, wordlen, mask)


def not_yet_indexed(seqs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Distinct contents that an index (a table with ``content_id``) lacks."""
    return distinct_contents(seqs).join(indexed.select("content_id"), "content_id", "left_anti")


def bucket_count(seqs: DataFrame, least=8) -> int:
    """Buckets for an index of sequences: as many as its words ask for, so a task sorts about ``WORDS`` of them."""
    letters = seqs.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    return max(least, -(-letters // WORDS))


def save_kmer_index(kmers: DataFrame, table: str, buckets: int, mode="overwrite"):
    """Stores an index bucketed and sorted by word, so that joins between
    indexes with equal bucket counts need no shuffle."""
    kmers.write.bucketBy(buckets, "kmer").sortBy("kmer").mode(mode).saveAsTable(table)


def merge_kmer_index(kmers: DataFrame, table: str, buckets: int):
    """Adds the words of arriving contents to a stored index, in its buckets. Words of contents that it has (see
    ``not_yet_indexed``) would count twice."""
    save_kmer_index(kmers, table, buckets, mode="append")


def join_stored(spark, s_table: str, t_table: str) -> DataFrame:
    """Occurrences of equal words in two stored indexes: ``(kmer, s_id, i, t_id, j)``. With equal bucket counts bucket meets
    bucket, so neither index is shuffled."""
    s = spark.table(s_table).select("kmer", F.col("seq_id").alias("s_id"), F.col("pos").alias("i"))
    t = spark.table(t_table).select("kmer", F.col("seq_id").alias("t_id"), F.col("pos").alias("j"))
    return s.hint("merge").join(t, "kmer")


def drop_kmer_index(spark, table: str):
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def kmer_hits(kmers: DataFrame, kmer: int) -> DataFrame:
    """Occurrences of one word."""
    return kmers.where(F.col("kmer") == F.lit(kmer)).select("seq_id", "pos")


def distinct_kmers(kmers: DataFrame) -> DataFrame:
    return kmers.where("kmer IS NOT NULL").select("kmer").distinct()


def kmer_spectrum(kmers: DataFrame) -> DataFrame:
    """Occurrences per word: ``(kmer, n)``."""
    return kmers.where("kmer IS NOT NULL").groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def abundance_histogram(kmers: DataFrame) -> DataFrame:
    """How many words occur ``n`` times: ``(n, n_kmers)``."""
    return kmer_spectrum(kmers).groupBy("n").agg(F.count(F.lit(1)).alias("n_kmers"))
