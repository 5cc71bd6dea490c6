"""Spelling variants by composing finite-state machines.

The words of a partition form a minimal acceptor. Composed with a transducer that makes exactly one edit, and with an
acceptor again, it accepts the pairs of words that are one edit apart. The transducer makes its edit where the two words
first differ, so each pair has one path. Once it has made the edit, both acceptors have to accept the same rest, and
that is worked out once for each pair of their states.

Partitions are initial states: the state after the first letters. Pairs that differ later are in one partition of the
acceptor, and pairs that differ in these letters are in one of the acceptor of the reversed words, as the words are long
enough. A partition with many words is composed part with part. Tasks return one row a word, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kmerweave.llm.common import batch_texts, cut_lineage, shuffles_end_with_jobs

#: Least length of a word in code points, and least number of its occurrences.
SHORTEST, LEAST = 7, 2
#: A near word is a word's form if it is so many times as frequent.
TIMES = 10
#: One run in so many loses a code point.
DELETED = 31
#: Words of a part of a partition.
PART = 1 << 13
#: Distinct words that a task counts before it passes them on.
HELD = 1 << 18

_RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")


def _counted(shortest: int, deleted: int):
    """Words and their counts in a task's texts, one row for each time that a word is passed on."""
    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
                                          names=["word", "n"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                seed = zlib.crc32(f"{doc}:".encode())
                for run, n in Counter(_RUN.findall(text)).items():
                    if len(run) < shortest:
                        continue
                    word = run.encode().lower()  # of bytes, only A-Z
                    h = zlib.crc32(word, seed)
                    if h % deleted == 0:
                        if len(run) == shortest:
                            continue
                        at, letters = h % len(run), word.decode()
                        word = (letters[:at] + letters[at + 1:]).encode()
                    counts[word] += n
                if len(counts) >= HELD:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)

    return rows


def vocabulary(docs: DataFrame, id_col="doc_id", text_col="text", shortest=SHORTEST, least=LEAST, deleted=DELETED) -> DataFrame:
    """``(word, n)``: the words of ``docs`` with ``shortest`` code points and ``least`` occurrences or more."""
    batch_texts(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("doc"),
                        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_counted(shortest, deleted), "word string, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least)


class Acceptors:
    """Minimal acceptors that share their states: states are equal if they accept the same rests of words."""

    def __init__(self):
        #: Of each state its arcs by letter; the letter '' says that a word ends.
        self.arcs: list[dict[str, int | None]] = []
        self._known: dict[tuple, int] = {}
        self._shares: dict[tuple[int, int], bool] = {}

    def _state(self, arcs: dict) -> int:
        key = tuple(arcs.items())
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
        return self._known[key]

    def add(self, words: list[str]) -> int:
        """The initial state of the acceptor of sorted, distinct words. A state is complete, and becomes known, once the
        next word leaves its path."""
        path: list[dict] = [{}]
        before = ""
        for word in words:
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            self._close(path, before, same)
            path += [{} for _ in range(len(word) - same)]
            path[-1][""] = None
            before = word
        self._close(path, before, 0)
        return self._state(path[0])

    def _close(self, path: list[dict], word: str, down_to: int) -> None:
        while len(path) > down_to + 1:
            arcs = path.pop()
            path[-1][word[len(path) - 1]] = self._state(arcs)

    def shares(self, one: int, other: int) -> bool:
        """Whether there is a rest that both states accept."""
        known, asked = self._shares, [(one, other)]
        while asked:
            pair = asked[-1]
            if pair not in known:
                a, b = self.arcs[pair[0]], self.arcs[pair[1]]
                further = [(a[x], b[x]) for x in a if x in b]
                open_ = [p for p in further if p[0] is not None and p not in known]
                if any(p[0] is None or known.get(p) for p in further):
                    known[pair] = True
                elif open_:
                    asked.append(open_[0])
                    continue
                else:
                    known[pair] = False
            asked.pop()
        return known[one, other]

    def common(self, one: int, other: int) -> Iterator[str]:
        """The rests that both states accept."""
        open_ = [("", one, other)] if self.shares(one, other) else []
        while open_:
            start, p, q = open_.pop()
            a, b = self.arcs[p], self.arcs[q]
            for x, p_next in a.items():
                if x in b:
                    if p_next is None:
                        yield start
                    elif self.shares(p_next, b[x]):
                        open_.append((start + x, p_next, b[x]))

    def near(self, one: int, other: int) -> Iterator[tuple[str, str]]:
        """The pairs of a word of either acceptor that are one edit apart; each pair of one acceptor's words comes once."""
        open_ = [("", one, other)]
        while open_:
            start, p, q = open_.pop()
            a, b = self.arcs[p], self.arcs[q]
            letters = list(a.items())
            for k, (x, p_next) in enumerate(letters):
                if p_next is None:
                    continue
                for y, q_next in (letters[k + 1:] if p == q else b.items()):
                    if y != x and q_next is not None:
                        for rest in self.common(p_next, q_next):
                            yield start + x + rest, start + y + rest
                for rest in self.common(p_next, q):
                    if not rest.startswith(x):
                        yield start + x + rest, start + rest
                if x in b:
                    open_.append((start + x, p_next, b[x]))
            if p != q:
                for y, q_next in b.items():
                    for rest in self.common(p, q_next) if q_next is not None else ():
                        if not rest.startswith(y):
                            yield start + rest, start + y + rest


def _composed(first: int):
    """Near words counted for each word of each partition, from rows sorted by ``key``; holds one partition's words."""
    def found(backward: bool, alone: bool, sides: list[dict[str, int]]) -> Iterator[pa.RecordBatch]:
        """``alone``: one part with itself. Otherwise words of one part are not compared with each other here."""
        if not (alone or all(sides)):
            return
        acceptors = Acceptors()
        turn = (lambda w: w[::-1]) if backward else (lambda w: w)
        roots = [acceptors.add(sorted(turn(w) for w in side)) for side in sides if side]
        count, best = Counter(), {}
        numbers = {w: n for side in sides for w, n in side.items()}
        for one, other in acceptors.near(roots[0], roots[-1]):
            one, other = turn(one), turn(other)
            if backward and one[:first] == other[:first]:
                continue
            for word, near in ((one, other), (other, one)):
                count[word] += 1
                rank = (-numbers[near], near)
                if word not in best or rank < best[word]:
                    best[word] = rank
        yield pa.RecordBatch.from_arrays([
            pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64()),
            pa.array([-best[w][0] for w in count], pa.int64()), pa.array([best[w][1] for w in count], pa.string())],
            names=["word", "n_near", "near_n", "near"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell, sides = None, (), [{}, {}]
        for batch in batches:
            for k, back, alone, side, word, n in zip(*(batch.column(c).to_pylist() for c in (
                    "key", "backward", "alone", "side", "word", "n"))):
                if k != key:
                    if key is not None:
                        yield from found(*cell, sides)
                    key, cell, sides = k, (back, alone), [{}, {}]
                sides[side][word] = n
        if key is not None:
            yield from found(*cell, sides)

    return rows


def near_words(words: DataFrame, shortest=SHORTEST) -> DataFrame:
    """``(word, n_near, near, near_n)`` of the words of ``(word, n)`` that have near words: one code point inserted, deleted
    or replaced. ``near`` is the most frequent of them, the smallest of ties. ``words`` has distinct words of ``shortest``
    code points or more, at least two."""
    first = shortest // 2
    states = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward")).withColumn(
        "state", F.when(F.col("backward"), F.reverse(F.substring("word", -first, first))).otherwise(F.substring("word", 1, first)))
    sizes = cut_lineage(states.groupBy("backward", "state").agg(F.count(F.lit(1)).alias("words")).where("words > 1").select(
        "backward", "state", F.ceil(F.col("words") / PART).cast("int").alias("parts")), "spelling-states")
    dealt = states.join(sizes, ["backward", "state"]).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "word", "n", "backward", (F.col("part") == F.col("other")).alias("alone"),
        (F.col("part") > F.col("other")).cast("int").alias("side"),
        F.concat_ws("|", F.col("backward").cast("string"), low, high, "state").alias("key"))
    found = cells.repartition("key").sortWithinPartitions("key").mapInArrow(
        _composed(first), "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", "best.near", (-F.col("best.n")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: forms followed to the last. A form is ``TIMES`` as frequent as its word, so
    chains are short, and each round follows twice as many steps."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut_lineage(roots.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            return roots


def variants(docs: DataFrame, id_col="doc_id", text_col="text", shortest=SHORTEST, least=LEAST, times=TIMES,
             deleted=DELETED) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of the words of ``docs``: runs of Latin letters, A-Z in lower case, of
    ``shortest`` code points and ``least`` occurrences or more.

    If ``deleted`` divides the checksum of ``<doc_id>:<run>``, the run first loses a code point that the checksum names.
    ``n_near`` counts the words that one inserted, deleted or replaced code point away; ``form`` is the most frequent of
    them (the smallest of ties) if it is at least ``times`` as frequent, else null, with its count ``form_n``; ``root`` is where
    forms lead in the end, the word itself if it has none.

    Null texts are empty, a null id is an empty text in the checksum. Repeated rows count again. Other columns are not
    read. ``shortest`` is two or more, ``times`` more than one.
    """
    with shuffles_end_with_jobs(docs.sparkSession):
        words = cut_lineage(vocabulary(docs, id_col, text_col, shortest, least, deleted), "spelling-words")
        near = words.join(near_words(words, shortest), "word", "left")
        is_form = F.col("near_n") >= times * F.col("n")
        formed = cut_lineage(near.select(
            "word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("near_n")).alias("form_n")), "spelling-forms")
        roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The digest of ``variants`` in DuckDB's SQL: checksums byte by byte, words without each of their letters joined.
SQL = f"""
WITH RECURSIVE remainders AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS r),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {SHORTEST} GROUP BY ALL),
sums AS (
  SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS digits, 0 AS i, 4294967295 AS c FROM runs
  UNION ALL SELECT run, n, digits, i + 1, xor(r[(xor(c, 16 * (instr('0123456789ABCDEF', digits[2 * i + 1]) - 1)
    + instr('0123456789ABCDEF', digits[2 * i + 2]) - 1) & 255) + 1], c >> 8)
  FROM sums, remainders WHERE 2 * i < length(digits)),
kept AS (SELECT run, n, xor(c, 4294967295) AS h FROM sums WHERE 2 * i = length(digits)),
words AS MATERIALIZED (
  SELECT CASE WHEN h % {DELETED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
    CAST(sum(n) AS BIGINT) AS n
  FROM kept GROUP BY 1 HAVING length(word) >= {SHORTEST} AND sum(n) >= {LEAST}),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON rest = words.word
  UNION SELECT words.word, cut.word FROM cut JOIN words ON rest = words.word),
best AS (
  SELECT pairs.word, count(*) AS n_near, min(struct_pack(n := -n, near := near)) AS b
  FROM pairs JOIN words ON words.word = near GROUP BY pairs.word),
forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= {TIMES} * n THEN b.near END AS form,
    CASE WHEN -b.n >= {TIMES} * n THEN -b.n END AS form_n
  FROM words LEFT JOIN best USING (word)),
steps AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT steps.word, forms.form FROM steps JOIN forms ON forms.word = steps.root WHERE forms.form IS NOT NULL)
SELECT forms.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM forms JOIN steps USING (word) WHERE root IN (SELECT word FROM forms WHERE form IS NULL)
"""
