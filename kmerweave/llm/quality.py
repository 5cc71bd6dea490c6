"""Quality of documents by weak supervision.

Each rule looks at one measure of a text and votes good, votes bad or abstains. Expectation-maximisation on the counts
of vote patterns (three to the number of rules at most, whatever the corpus) estimates how often each rule votes good
on good and on bad documents. A document's posterior probability of being good follows from its votes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kmerweave.llm.common import cut_lineage, texts_of

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5
#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = frozenset("""a an and are as at be by for from in is it not of on or that the this to was with
    au aux dans des du elle en est et la le les par pas pour que qui sur un une
    das dem den der die ein eine ist mit nicht und von zu
    con del el los las para por se su una y""".encode().split())

_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_EDGES = b".,;:!?\"'()[]"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper",
            "n_calls", "n_bars", "n_stop_words", "n_distinct_words")


def repeat_words(words: list[bytes], joined: bytes) -> int:
    """Words inside windows of ``REPEAT_WINDOW`` words that the text has at least twice."""
    if len(words) <= REPEAT_WINDOW:
        return 0
    ends = list(accumulate(len(w) + 1 for w in words))
    windows = [joined[a:b - 1] for a, b in zip([0, *ends], ends[REPEAT_WINDOW - 1:])]
    if len(set(windows)) == len(windows):
        return 0
    first, covered = {}, np.zeros(len(words) + 1, np.int64)
    for at, window in enumerate(windows):
        was = first.setdefault(window, at)
        if was != at:
            for start in {was, at}:
                covered[start] += 1
                covered[start + REPEAT_WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The ``MEASURES`` of a text."""
    words = text.split()
    solid, joined = b"".join(words), b" ".join(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    lowered = joined.lower().split()
    without_upper = len(solid.translate(None, _UPPER))
    letters = len(solid) - len(solid.lower().translate(None, _UPPER.lower()))
    return (len(words), len(solid.translate(None, _CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeat_words(words, joined), letters,
            len(solid) - without_upper, solid.count(b"!"), words.count(b"|"),
            sum(map(STOP_WORDS.__contains__, [w.rstrip(_EDGES) for w in lowered])), len(set(words)))


@F.arrow_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def _measured(text: pa.Array) -> pa.Array:
    rows = [measure(t) for t in text.to_pylist()]
    columns = zip(*rows) if rows else [[] for _ in MEASURES]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


def measures(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id`` and the ``MEASURES`` of every row; a null text is empty."""
    return texts_of(docs, id_col, text_col).select("doc_id", _measured("text").alias("m")).select("doc_id", "m.*")


@dataclass(frozen=True)
class Rule:
    """Votes good below (or, if ``more`` is better, from) ``good`` on, bad beyond ``bad``, nothing in between."""

    name: str
    part: str
    whole: str
    good: float
    bad: float
    more: bool = False

    def vote(self) -> Column:
        share = F.col(self.part) / F.greatest(F.col(self.whole), F.lit(1))
        good, bad = (share >= self.good, share < self.bad) if self.more else (share <= self.good, share > self.bad)
        return F.when(F.col("n_words") == 0, 0).when(good, 1).when(bad, -1).otherwise(0)


#: Documented parameters: the rules of this library.
RULES = (
    Rule("few_symbols", "n_symbols", "n_words", 0.03, 0.1),
    Rule("few_bars", "n_bars", "n_words", 0.02, 0.1),
    Rule("few_repeated_lines", "n_dup_lines", "n_lines", 0.1, 0.3),
    Rule("few_repeated_words", "n_repeat_words", "n_words", 0.05, 0.2),
    Rule("few_capitals", "n_upper", "n_letters", 0.2, 0.5),
    Rule("few_calls", "n_calls", "n_words", 0.05, 0.2),
    Rule("stop_words", "n_stop_words", "n_words", 0.1, 0.03, more=True),
    Rule("varied_words", "n_distinct_words", "n_words", 0.2, 0.08, more=True),
    Rule("word_length_not_long", "word_chars", "n_words", 9.0, 13.0),
    Rule("word_length_not_short", "word_chars", "n_words", 3.0, 2.2, more=True),
)


@dataclass(frozen=True)
class Votes:
    """What expectation-maximisation found: the share of good documents, and for each rule how often it votes good,
    when it votes, on good and on bad documents."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def log_odds(self) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for n, (g, b) in enumerate(zip(self.on_good, self.on_bad)):
            vote = F.col("votes")[n]
            odds = odds + F.when(vote == 1, math.log(g / b)).when(vote == -1, math.log((1 - g) / (1 - b))).otherwise(0.0)
        return odds

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds=200) -> Votes:
    """Expectation-maximisation over vote patterns (a row each, votes -1, 0 and 1) with the documents that have them.
    It starts from documents without a bad vote as good. Pseudo-counts keep rates inside (0, 1)."""
    k = patterns.shape[1] if len(patterns) else 0
    good = np.where((patterns < 0).any(axis=1), 0.1, 0.9) if len(patterns) else np.zeros(0)
    votes_good, votes_bad = (patterns == 1).astype(float), (patterns == -1).astype(float)
    prior, on_good, on_bad = 0.5, np.full(k, 0.9), np.full(k, 0.5)
    for _ in range(rounds):
        weight, other = counts * good, counts * (1 - good)
        prior = (weight.sum() + 1) / (counts.sum() + 2)
        on_good = (weight @ votes_good + 9.9) / (weight @ (votes_good + votes_bad) + 10)
        on_bad = (other @ votes_good + 5) / (other @ (votes_good + votes_bad) + 10)
        odds = math.log(prior / (1 - prior)) + votes_good @ np.log(on_good / on_bad) + votes_bad @ np.log(
            (1 - on_good) / (1 - on_bad))
        now = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.allclose(now, good, atol=1e-9):
            break
        good = now
    return Votes(float(prior), tuple(map(float, on_good)), tuple(map(float, on_bad)))


def judged(docs: DataFrame, id_col="doc_id", text_col="text", rules=RULES) -> DataFrame:
    """``doc_id``, the ``MEASURES``, ``votes`` (one of -1, 0, 1 for each rule) and ``p_good`` of every row.

    Texts without words get no vote, so their probability is the corpus' share of good documents. Rows without an id
    and repeated rows are judged like any other.
    """
    voted = cut_lineage(measures(docs, id_col, text_col).withColumn("votes", F.array(*[r.vote() for r in rules])),
                        "quality")
    found = voted.groupBy("votes").count().collect()  # at most 3 ** len(rules) rows
    found.sort(key=lambda row: row["votes"])
    model = fit(np.array([r["votes"] for r in found]).reshape(-1, len(rules)), np.array([r["count"] for r in found], float))
    return voted.withColumn("p_good", model.probability())
