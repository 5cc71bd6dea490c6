"""Mixing sources to target weights along a time-varying curriculum.

A source's weight follows a schedule over the training time from 0 to 1: the rate ``1 + slope * (2 t - 1)``, whose
integral up to ``t`` is ``(1 - slope) t + slope t^2``. Times the source's target this is the demand up to ``t``. The
source's documents, in an order that only their ids decide, meet that demand one after another; the inverse of the
demand gives each of them its training position. Documents are read again from the start when a pass is over.

A source that does not fit its target a whole number of times leaves a rest. Its long documents (over twice the mean) meet
their share of the rest as well as they can, and the short ones meet what is then left. So a source comes to its target to
within about half a short document.

Running totals come from one window inside buckets of about ``BUCKET`` documents and one over the buckets' sums, so a
source of any size is dealt over many tasks. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kmerweave.llm.common import WORD, cut_lineage, fresh

#: No document is taken more often.
MAX_PASSES = 3
#: Documents that a bucket of a source has on average.
BUCKET = 4096
#: Slope of the schedule for weights 1, 2 and 3: the heavier a source, the later it comes.
SLOPES = (-0.5, 0.0, 0.5)


def n_words(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source) -> Column:
    """Sorts like the source by code point, null last; never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def _place(doc_id) -> tuple[Column, Column]:
    """A document's place in its source's order: a number from 0 up to 1 and, finer and in the same order, a key."""
    key = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32), key


def targets(sized: DataFrame) -> DataFrame:
    """Targets of sources: ``(key, n_docs, source_size, weight, target)`` from rows ``(key, size)``.

    Sources by order of ``key`` weigh 1, 2, 3, repeating, and share the sum of all sizes. A target stops at
    ``MAX_PASSES`` times the source's size, and the others share the excess by weight. In order of the level (target by
    weight) at which sources reach their limits, a source is at its limit if it reaches it before the level that is
    left when all sources before it are at theirs.
    """
    sources = sized.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    weight = ((F.row_number().over(Window.orderBy("key")) - 1) % 3 + 1).cast("double")
    limit = MAX_PASSES * F.col("source_size")
    everything = Window.partitionBy()
    before = Window.orderBy("fills_at", "key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = sources.withColumn("weight", weight).withColumn("limit", limit).withColumn(
        "fills_at", F.col("limit") / F.col("weight")).withColumn("level", level).withColumn(
        "full", F.col("fills_at") < F.col("level"))
    final = F.min(F.when(~F.col("full"), F.struct("fills_at", "key", "level"))).over(everything)["level"]
    return filled.withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        F.col("weight") * final)).select("key", "n_docs", "source_size", "weight", "target")


def assign(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", out_col="mix", size_col=None) -> DataFrame:
    """``docs`` with the struct ``out_col`` (in place of a column of that name): ``size`` in words, ``source_size``,
    ``target``, ``weight``, ``start`` (words of its source that come before it in a pass), ``passes`` (how often the
    mix takes the document) and ``taken`` (``passes`` times ``size``).

    Every document is taken as often as its source fits into the target, and some of them once more to meet the rest.
    Texts that are null or without words have size 0. A ``size_col`` has sizes counted before (see ``sizes``), and no text
    is read. Rows without id share a place in the order, as repeated rows do.
    The result is the same in every run.
    """
    row, mix = fresh(docs, "row"), fresh(docs, out_col + "_")
    share, order = _place(docs[id_col])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), _source_key(docs[source_col]).alias("key"),
                       (docs[size_col] if size_col else n_words(docs[text_col])).alias("size"), docs[id_col].alias("id"), share.alias("share"),
                       order.alias("order"))
    sources = cut_lineage(targets(rows.select("key", "size")), "mix-sources")
    dealt = rows.join(sources, "key").withColumn("long", F.col("size") * F.col("n_docs") > 2 * F.col("source_size")).withColumn(
        "bucket", F.floor(F.col("share") * F.ceil(F.col("n_docs") / BUCKET)).cast("long"))
    offsets = cut_lineage(_offsets(dealt), "mix-offsets")
    rests = cut_lineage(_rests(_placed(dealt.where("long").drop(row), offsets), sources), "mix-rests")
    placed = _placed(dealt, offsets).join(rests, "key")
    rest = F.when(F.col("long"), F.coalesce("long_rest", F.lit(0.0))).otherwise(F.col("rest") - F.col("long_taken"))
    passes = F.col("whole") + _once_more(rest)
    passes = F.least(passes, F.lit(MAX_PASSES)).cast("long")
    start = F.when(F.col("kind_size") > 0, F.col("start") * F.col("source_size") / F.col("kind_size")).otherwise(0.0)
    found = F.struct("size", "source_size", "target", "weight", start.alias("start"), passes.alias("passes"),
                     (passes * F.col("size")).alias("taken"))
    others = [F.col(f"{row}.`{c}`") for c in docs.columns if c != out_col]
    return placed.select(row, found.alias(mix)).select(*others, F.col(mix).alias(out_col))


def _once_more(rest) -> Column:
    return ((F.col("size") > 0) & (F.col("start") + F.col("size") / 2 <= rest)).cast("int")


def _offsets(dealt: DataFrame) -> DataFrame:
    """Words before each bucket of a source's long or short documents, and of all of these."""
    sums = dealt.groupBy("key", "long", "bucket").agg(F.sum("size").alias("bucket_size"))
    kind = Window.partitionBy("key", "long")
    before = F.sum("bucket_size").over(kind.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("key", "long", "bucket", F.coalesce(before, F.lit(0)).alias("offset"),
                       F.sum("bucket_size").over(kind).alias("kind_size"))


def _placed(dealt: DataFrame, offsets: DataFrame) -> DataFrame:
    inside = Window.partitionBy("key", "long", "bucket").orderBy("order", "id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    return dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, ["key", "long", "bucket"]).withColumn("start", F.col("offset") + F.col("inside"))


def _rests(long: DataFrame, sources: DataFrame) -> DataFrame:
    """Of each source: whole passes, the rest, the long documents' share of it and the words they take for it."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    both = sources.select("key", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest"))
    share = F.col("rest") * F.col("kind_size") / F.col("source_size")
    met = long.join(both.drop("whole"), "key").groupBy("key").agg(
        F.first(share).alias("long_rest"), F.sum(_once_more(share) * F.col("size")).alias("long_taken"))
    return both.join(met, "key", "left").withColumn("long_taken", F.coalesce("long_taken", F.lit(0)))


def position(mix: str, pass_number) -> Column:
    """When, from 0 to 1, a document of a pass (from 0 on) comes: the inverse of its source's demand."""
    c = lambda name: F.col(f"{mix}.{name}")
    met = pass_number * c("source_size") + c("start") + c("size") / 2
    share = F.when(c("target") > 0, F.least(met / c("target"), F.lit(1.0))).otherwise(0.0)
    slope = F.element_at(F.array(*[F.lit(s) for s in SLOPES]), c("weight").cast("int"))
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / (2 * slope))


def sizes(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", out_col="size") -> DataFrame:
    """Ids, sources and sizes in words (``out_col``), counted once and stored: what the mix is worked out from."""
    return cut_lineage(docs.select(id_col, source_col, n_words(docs[text_col]).alias(out_col)), "mix-sizes")


def curriculum(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", out_col="position", size_col=None,
               mix_col=None) -> DataFrame:
    """The mix in training order: a row for each pass that takes a document, with the columns of ``docs`` and its
    training position as ``out_col`` (in place of a column of that name), range-sorted by position. Documents without words
    come once, where their source has come to; documents that the mix does not take are not in it.

    With ``mix_col`` rows have the struct of ``assign``, too, documents that the mix does not take come once, without a
    position, and documents without words come in each whole pass of their source.
    """
    mix, number = fresh(docs, mix_col or "mix"), fresh(docs, "pass")
    taken = assign(docs, id_col, text_col, source_col, mix, size_col)
    taken_times = F.col(f"{mix}.passes").cast("int")
    empty_times = F.greatest(taken_times, F.lit(1)) if mix_col else F.lit(1)
    times = F.when(F.col(f"{mix}.size") == 0, empty_times).otherwise(taken_times)
    passes = F.when(times > 0, F.sequence(F.lit(0), times - 1))
    each = taken.withColumn(number, F.explode_outer(passes) if mix_col else F.explode(passes))
    placed = each.withColumn(out_col, F.when(F.col(number).isNotNull(), position(mix, F.col(number))))
    # Rows without a position are told apart by their ids.
    dealt = placed.repartitionByRange(out_col, id_col) if mix_col else placed.repartitionByRange(out_col)
    ordered = dealt.sortWithinPartitions(out_col, id_col).drop(number)
    return ordered if mix_col else ordered.drop(mix)


def summed(ordered: DataFrame, id_col="doc_id", position_col="position", mix_col="mix") -> DataFrame:
    """What each document's passes add up to, from the rows of ``curriculum``: ``(doc_id, size, source_size, target, taken,
    first_position, last_position)``. Rows that repeat an id and a size are one document."""
    size = F.col(f"{mix_col}.size")
    return ordered.groupBy(F.col(id_col).alias("doc_id"), size.alias("size"), F.col(f"{mix_col}.source_size").alias("source_size"),
                           F.col(f"{mix_col}.target").alias("target")).agg(
        F.sum(F.when(F.col(position_col).isNull(), 0).otherwise(size)).alias("taken"),
        F.min(position_col).alias("first_position"), F.max(position_col).alias("last_position"))


#: The same mix and its positions in DuckDB's SQL.
SQL = """
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 't') AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
sources AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM sized GROUP BY key),
levels AS (
  SELECT *, 3 * source_size / weight AS fills_at,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM sources
  WINDOW w AS (ORDER BY 3 * source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT key, source_size,
         CASE WHEN fills_at < level THEN CAST(3 * source_size AS DOUBLE)
              ELSE weight * (SELECT arg_min(level, (fills_at, key)) FROM levels WHERE NOT fills_at < level) END AS target
  FROM levels),
kinds AS (
  SELECT doc_id, key, size, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest,
         size * count(*) OVER (PARTITION BY key) > 2 * source_size AS long, place
  FROM sized JOIN targets USING (key)),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY key, long) AS kind_size,
         coalesce(sum(size) OVER (PARTITION BY key, long ORDER BY place, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM kinds),
first_met AS (
  SELECT *, CASE WHEN long AND size > 0 AND start + size / 2 <= rest * kind_size / source_size THEN 1 ELSE 0 END AS longer
  FROM placed),
met AS (
  SELECT *, CASE WHEN long THEN longer
                 WHEN size > 0 AND start + size / 2 <= rest - sum(longer * size) OVER (PARTITION BY key) THEN 1
                 ELSE 0 END AS more
  FROM first_met),
timed AS (
  SELECT *, least(whole + more, 3) AS passes, CASE WHEN kind_size > 0 THEN start * source_size / kind_size ELSE 0 END AS first_word,
    SLOPES[CAST(weight AS INTEGER)] AS slope
  FROM met JOIN (SELECT key, weight FROM sources) USING (key)),
shares AS (
  SELECT *, pass, CASE WHEN target > 0 THEN least((pass * source_size + first_word + size / 2) / target, 1) ELSE 0 END AS share
  FROM timed, unnest(list_distinct([0, greatest(passes, 1) - 1])) AS u(pass)),
positions AS (
  SELECT doc_id, size, source_size, target, CASE WHEN pass = 0 THEN passes * size ELSE 0 END AS taken, CASE WHEN passes > 0 OR size = 0 THEN
    CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END END AS position
  FROM shares)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(sum(taken) AS BIGINT) AS taken,
  round(min(position), 9) AS first_position, round(max(position), 9) AS last_position
FROM positions GROUP BY doc_id, size, source_size, target
""".replace("SLOPES", str([float(s) for s in SLOPES]))
