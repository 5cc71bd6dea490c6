"""Phrases whose words stand together more often than chance, counted by sorting suffixes.

Every word of a text is a suffix pointer: it stands for the words from there on, up to the longest phrase and the end of
its piece. Pointers with the same first words form a partition, and the size of a partition is the count of its phrase.

1. The leading words of all pointers are counted globally, by hash: one and two words, then three of those whose first
   and last two are left, and so on. Partitions too small for any candidate are abandoned: a filter of fixed size tells
   which leading words are left. It may keep some in vain, and drops none.
2. Tasks cut pointers where their partition was abandoned and count equal ones; what is left is routed by the leading two
   words, and single words by themselves. Leading words with very many pointers go to several tasks by the third word.
3. There a three-way quicksort on one word after the other splits all partitions in step, leaves those that became too
   small, goes one word deeper in those of equal words, and reports how large they are.

Counts are exact, as hashes decide only where a pointer goes and which partitions are surely too small.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from kmerweave.llm.common import batch_texts, cut_lineage, shuffles_end_with_jobs
from kmerweave.llm.hashing import mix, span_hashes

#: Longest phrase, least count of a candidate, share (percent) of its count at which a longer one replaces it, and how
#: many are listed of each language.
LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: The filter of leading words has so many bits: 16 MB, whatever the corpus.
FILTER_BITS = 1 << 27
#: Leading words with more pointers than this go to several tasks; a filter of this many bits tells which ones.
ROWS_PER_TASK, HOT_BITS = 1 << 19, 1 << 20
#: Bytes of text that are read at a time, rows that a task puts together before it passes them on, rows of a batch that
#: it passes on, and pointers that are sorted at a time.
TOGETHER, HELD, BATCH, POINTERS = 1 << 20, 1 << 20, 1 << 16, 1 << 18

_GAP, _END = np.zeros(256, bool), np.zeros(256, bool)
_GAP[[9, 32]] = True
_END[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pointers:
    """The words of some texts in order, and how many words of its piece each has from itself on, up to ``longest``."""

    def __init__(self, langs: list[bytes], texts: list[bytes], longest: int):
        self.data = b"\n".join(texts).lower() + b"\n"
        letters = np.frombuffer(self.data, np.uint8)
        outside = np.concatenate([[True], (_GAP | _END)[letters]])
        self.starts = np.flatnonzero(outside[:-1] & ~outside[1:])
        self.ends = np.flatnonzero(~outside[:-1] & outside[1:])
        piece = np.cumsum(_END[letters])[self.starts]
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.starts, side="right")
        self.names, numbers = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = numbers[owner]
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        # Not the hash of a word that looks like the language's name.
        with np.errstate(over="ignore"):
            self.seed_of = mix(span_hashes(*_joined(list(self.names))) + _STEP)
        self.seeds = self.seed_of[self.lang]
        self.depth = np.ones(len(piece), np.int64)
        for further in range(1, longest):
            inside = piece[further:] == piece[:-further] if len(piece) > further else np.zeros(0, bool)
            self.depth[:len(inside)] += inside

    def leading(self, depth: int) -> list[np.ndarray]:
        """Hashes of the language and the first 1, 2, ... ``depth`` words of each pointer; not for pointers that end before."""
        found = [mix(self.hashes ^ self.seeds)]
        for further in range(1, depth):
            key = np.zeros(len(self.hashes), np.uint64)
            with np.errstate(over="ignore"):
                key[:-further or None] = mix(found[-1][:-further or None] * _STEP + self.hashes[further:]) + np.uint64(further)
            found.append(key)
        return found

    def phrases(self, at: np.ndarray, depth: np.ndarray) -> list[bytes]:
        starts, ends = self.starts.tolist(), self.ends.tolist()
        return [b" ".join([self.data[starts[k]:ends[k]] for k in range(p, p + d)]) for p, d in zip(at.tolist(), depth.tolist())]


def _joined(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return b"\n".join(words) + b"\n", ends - [len(w) for w in words], ends


def _batched(batches: Iterable[pa.RecordBatch], longest: int) -> Iterator[Pointers]:
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            langs.append(lang)
            texts.append(text)
            size += len(text) + 1
            if size >= TOGETHER:
                yield Pointers(langs, texts, longest)
                langs, texts, size = [], [], 0
    if texts:
        yield Pointers(langs, texts, longest)


def _leading_counts(depths: list[int], left: Broadcast | None):
    """How many pointers of a task's texts begin with the same words, for several numbers of words. With ``left``, only of
    those whose first and last words, one less, are left."""
    def passed_on(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        leads, n = np.unique(np.concatenate(held), return_counts=True)
        yield from _in_batches(pa.table({"lead": leads.view(np.int64), "n": n}))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(left.value, np.uint64) if left else None
        held, size = [], 0
        for pointers in _batched(batches, depths[-1]):
            leads = pointers.leading(depths[-1])
            for d in depths:
                alive = pointers.depth >= d
                if left:
                    before = _is_in(words, leads[d - 2])
                    alive = alive & before & np.append(before[1:], False)
                held.append(leads[d - 1][alive])
                size += len(held[-1])
            if size >= HELD:
                yield from passed_on(held)
                held, size = [], 0
        if size:
            yield from passed_on(held)

    return rows


def _in_batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return iter(table.combine_chunks().to_batches(max_chunksize=BATCH))


def _summed(blocks: list[tuple[np.ndarray, pa.Table]]) -> Iterator[pa.RecordBatch]:
    """Rows of all blocks; of rows with one key, one with the sum of their ``n``."""
    keys, rows = np.concatenate([k for k, _ in blocks]), pa.concat_tables([t for _, t in blocks])
    _, at, which = np.unique(keys, return_index=True, return_inverse=True)
    n = np.zeros(len(at), np.int64)
    np.add.at(n, which, rows["n"].to_numpy())
    return _in_batches(rows.drop_columns("n").take(pa.array(at)).append_column("n", pa.array(n)))


def _suffixes(left: Broadcast, hot: Broadcast, longest: int):
    """Distinct pointers of a task's texts, cut where their leading words are in no partition that is left: of two words
    and more; of one word, for all pointers; and of none, for all words of a language. Not ``whole`` are those whose
    leading words go to several tasks."""
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, many = (np.frombuffer(x.value, np.uint64) for x in (left, hot))
        blocks, size = [], 0
        for pointers in _batched(batches, longest):
            if not len(pointers.starts):
                continue
            blocks.append(distinct(pointers, words, many))
            size += len(blocks[-1][0])
            if size >= HELD:
                yield from _summed(blocks)
                blocks, size = [], 0
        if size:
            yield from _summed(blocks)

    def distinct(pointers: Pointers, words: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, pa.Table]:
        leads = pointers.leading(longest)
        depth, going, same = np.zeros(len(leads[0]), np.int64), np.ones(len(leads[0]), bool), leads[0].copy()
        for d in range(longest):
            going = going & (pointers.depth > d) & _is_in(words, leads[d])
            depth += going
            same[going] = leads[d][going]
        single, longer = np.flatnonzero(depth), np.flatnonzero(depth > 1)
        langs, spoken = np.unique(pointers.lang, return_counts=True)
        found = [(pointers.seed_of[langs], np.unique(pointers.lang, return_index=True)[1], spoken, 0 * langs)]
        for at, value in ((single, leads[0]), (longer, same)):
            key, first, n = np.unique(value[at], return_index=True, return_counts=True)
            found.append((key, at[first], n, depth[at[first]] if at is longer else np.ones(len(n), np.int64)))
        same, at, n, depth = (np.concatenate(x) for x in zip(*found))
        split = (depth > 1) & _is_in(many, leads[1][at])
        names = pa.DictionaryArray.from_arrays(pa.array(pointers.lang[at].astype(np.int32)), pa.array(pointers.names.tolist(), pa.binary()))
        return same, pa.table({
            "lang": names.cast(pa.binary()).cast(pa.string()),
            "phrase": pa.array(pointers.phrases(at, depth), pa.binary()).cast(pa.string()),
            "whole": ~split, "n": n})

    return rows


def _is_in(words: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Whether both bits that stand for a hash are set."""
    found, last = np.ones(len(lead), bool), np.uint64(64 * len(words) - 1)
    for place in (lead & last, (lead >> np.uint64(32)) & last):
        found &= (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _filter(counts: DataFrame, bits: int, before: bytes | None = None) -> bytes:
    """The bits of all leading words in ``counts``, besides those ``before``; its size does not depend on the corpus."""
    low, high = (place.bitwiseAND(F.lit(bits - 1)) for place in (F.col("lead"), F.shiftrightunsigned("lead", 32)))
    words = counts.select(F.explode(F.array(low, high)).alias("place")).groupBy(
        F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
    table = words.toArrow()
    out = np.frombuffer(before or bytes(bits // 8), np.int64).copy()
    out[table["word"].to_numpy()] |= table["bits"].to_numpy()
    return out.tobytes()


def partitions(symbols: list[np.ndarray], weights: np.ndarray, whole: np.ndarray, least: int, shallowest: int):
    """Yields ``(depth, pointers, sizes)``: for all partitions of pointers with ``depth`` equal first symbols one of
    their pointers each and the sum of their ``weights``, if that is at least ``least`` and ``depth`` at least ``shallowest``.

    ``symbols[d][p]`` is pointer p's symbol at depth d; a negative one means that it has ended. All partitions are split in
    step, three ways by a symbol from their middle. One that is too small is abandoned, unless a pointer in it is not
    ``whole``, that is, others of its partition are in other tasks.
    """
    at = np.arange(len(weights))
    segment, depth = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    keys = np.stack(symbols)
    while len(at):
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(first, len(at)))
        number = np.repeat(np.arange(len(first)), size)
        symbol = keys[depth, at]
        pivot = symbol[first + size // 2]
        side = np.sign(symbol - pivot[number]) + 1
        part = 3 * number + side
        order = np.argsort(part, kind="stable")
        at, part, depth = at[order], part[order], depth[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.append(first, len(at)))
        total = np.add.reduceat(weights[at], first)
        stays = (total >= least) | ~np.logical_and.reduceat(whole[at], first)
        equal = part[first] % 3 == 1
        ended = equal & (pivot[part[first] // 3] < 0)
        deeper = equal & ~ended
        for d in np.unique(depth[first[deeper & stays]]):
            found = np.flatnonzero(deeper & stays & (depth[first] == d))
            if d + 1 >= shallowest:
                yield int(d) + 1, at[first[found]], total[found]
        going = stays & ~ended & ~(deeper & (depth[first] + 1 == len(keys)))
        depth = depth + np.repeat(deeper, size)
        kept = np.repeat(going, size)
        at, segment, depth = at[kept], part[kept], depth[kept]


def _sorted_counts(longest: int, least: int):
    """Phrases and their counts, of a partition sorted by ``key``; holds about ``POINTERS`` and one key's pointers. Counts of
    leading words that are not ``whole`` are parts of a sum."""
    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        longer = pc.match_substring(table["phrase"], " ")
        for rows, shallowest in ((table.filter(pc.invert(longer)), 2), (table.filter(longer), 3)):
            if rows.num_rows:
                yield from counts(rows.combine_chunks(), shallowest)

    def counts(rows: pa.Table, shallowest: int) -> Iterator[pa.RecordBatch]:
        words = pc.split_pattern(rows["phrase"], " ").combine_chunks()
        first = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode().indices.to_numpy()
        length = np.diff(first)
        lang = rows["lang"].combine_chunks().dictionary_encode().indices.to_numpy()
        symbols = [lang.astype(np.int64)]
        for d in range(longest):
            symbols.append(np.where(length > d, coded[np.minimum(first[:-1] - first[0] + d, len(coded) - 1)], -1).astype(np.int64))
        for depth, at, total in partitions(symbols, rows["n"].to_numpy(), rows["whole"].to_numpy(), least, shallowest):
            phrases = pc.binary_join(pc.list_slice(words.take(pa.array(at)), 0, depth - 1), " ")
            yield pa.RecordBatch.from_arrays([rows["lang"].combine_chunks().take(pa.array(at)), phrases,
                                              pa.array(total)], names=["lang", "phrase", "n"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= POINTERS:
                held = pa.Table.from_batches(held).combine_chunks().to_batches()
                keys = np.concatenate([b.column("key").to_numpy() for b in held])
                other = np.flatnonzero(keys != keys[-1])
                if len(other):
                    table = pa.Table.from_batches(held)
                    yield from found(table.slice(0, other[-1] + 1))
                    held = table.slice(other[-1] + 1).to_batches()
                    size = len(keys) - int(other[-1]) - 1
        if size:
            yield from found(pa.Table.from_batches(held))

    return rows


def _lengths(phrase: str):
    return F.length(phrase) - F.length(F.replace(F.col(phrase), F.lit(" "))) + 1


def counted(docs: DataFrame, text_col="text", lang_col="lang", longest=LONGEST, least=LEAST) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, f)`` of all phrases of up to ``longest`` words that occur ``least`` times or more within pieces of
    the texts of a language, and ``(lang, n)``, how many words its texts have, if these are ``least`` or more."""
    batch_texts(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).cast("binary").alias("lang"),
                        F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"))
    share = docs.sparkSession.sparkContext.broadcast
    left, hot = None, None
    for depths in [[1, 2], *([d] for d in range(3, longest + 1))]:
        counts = texts.mapInArrow(_leading_counts(depths, left and share(left)), "lead bigint, n bigint").groupBy("lead").agg(
            F.sum("n").alias("n"))
        counts = cut_lineage(counts.where(F.col("n") >= least), "collocations-leading")
        hot = hot or _filter(counts.where(F.col("n") > ROWS_PER_TASK), HOT_BITS)
        left = _filter(counts, FILTER_BITS, left)
    suffixes = texts.mapInArrow(_suffixes(share(left), share(hot), longest), "lang string, phrase string, whole boolean, n bigint")
    # Worked out on either side of the shuffle, as it would be a good part of what a row weighs.
    leading, third = (F.substring_index("phrase", " ", k) for k in (2, 3))
    key = F.xxhash64("lang", leading, F.when(~F.col("whole"), F.substring_index(third, " ", -1)))
    parts = suffixes.repartition(key).withColumn("key", key).sortWithinPartitions("key").mapInArrow(
        _sorted_counts(longest, least), "lang string, phrase string, n bigint")
    found = cut_lineage(parts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "collocations-phrases")
    return found.where("phrase <> ''"), found.where("phrase = ''").select("lang", F.col("f").alias("n"))


def _scored(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of all phrases of two and more words, by their lowest-scoring cut."""
    cuts = phrases.withColumn("words", _lengths("phrase")).where("words > 1").select(
        "lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - words)").alias("rest"))
    first = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = {c: f"cast({c} as decimal(15, 0))" for c in "alr"}
    score = F.expr(f"cast({wide['a']} * {wide['a']} * 1000000bd div ({wide['l']} * {wide['r']}) as bigint)")
    return cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).withColumn("score", score).groupBy(
        "lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _parts_of(phrases: DataFrame) -> DataFrame:
    """The largest count of a longer phrase around each phrase that is inside one: ``(lang, phrase, around)``."""
    longer = phrases.withColumn("words", F.split("phrase", " ")).where("size(words) > 2")
    parts = longer.select("lang", "f", F.explode(F.expr(
        "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), "
        "i -> array_join(slice(words, i, m), ' '))))")).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("around"))


def collocations(docs: DataFrame, text_col="text", lang_col="lang", longest=LONGEST, least=LEAST, covered=COVERED,
                 top=TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: of each language the ``top`` phrases of 2 to ``longest`` words by score,
    then count ``a``, then the phrase (UTF-8 order).

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces, these at spaces and tabs into words; no
    phrase crosses pieces. The cut of a phrase in two parts with counts ``l`` and ``r`` scores ``floor(10^6 a^2 / (l r))``,
    exact for counts below 10^15; the lowest counts, the leftmost of ties. A phrase inside a longer one with ``covered``
    percent of its count is left out. ``n`` counts the language's words.

    Null texts are empty, a null language is ``und``. Repeated rows count again. Other columns are not read.
    """
    with shuffles_end_with_jobs(docs.sparkSession):
        phrases, sizes = counted(docs, text_col, lang_col, longest, least)
        scored = cut_lineage(_scored(phrases).join(_parts_of(phrases), ["lang", "phrase"], "left").where(
            F.expr(f"around is null or 100 * around < {covered} * a")), "collocations-scored")
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = cut_lineage(scored.withColumn("rank", F.row_number().over(best).cast("long")).where(
            F.col("rank") <= top), "collocations-ranked")
        sizes = cut_lineage(sizes, "collocations-sizes")
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The digest of ``collocations`` with phrases of two and three words in DuckDB's SQL.
SQL = f"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(list_zip(w[:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2]))
  FROM words WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(list_zip(w[:len(w) - 2], w[2:len(w) - 1], w[3:]),
    lambda p: p[1] || ' ' || p[2] || ' ' || p[3]))
  FROM words WHERE len(w) > 2),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
cuts AS (
  SELECT lang, size, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS left_part,
    array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS right_part
  FROM f, unnest(range(1, size)) AS u(k)),
scored AS (
  SELECT c.lang, c.phrase, any_value(a) AS a, min(struct_pack(
    score := CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT), k := k, l := x.f, r := y.f)) AS cut
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = left_part JOIN f y ON y.lang = c.lang AND y.phrase = right_part
  GROUP BY c.lang, c.phrase),
around AS (
  SELECT lang, part AS phrase, max(f) AS around
  FROM (SELECT lang, f, unnest([string_split(phrase, ' ')[1] || ' ' || string_split(phrase, ' ')[2],
    string_split(phrase, ' ')[2] || ' ' || string_split(phrase, ' ')[3]]) AS part FROM f WHERE size = 3) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank
  FROM scored LEFT JOIN around USING (lang, phrase) WHERE around IS NULL OR 100 * around < {COVERED} * a)
SELECT lang, rank, phrase, a, cut.l AS l, cut.r AS r, n, cut.score AS score FROM ranked JOIN sizes USING (lang)
WHERE rank <= {TOP}
"""
