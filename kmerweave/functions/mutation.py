"""The mutation model and the alignment scores it implies."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from kmerweave.functions.alphabet import Alphabet


@dataclass
class MutationModel:
    """Substitution matrix (or one overall rate), gap-open and gap-extend
    probabilities, and the distribution of inserted letters (uniform by default)."""

    alphabet: Alphabet
    subst_probs: object = 0.0
    ge_prob: float = 0.0
    go_prob: float = 0.0
    insert_dist: object = None

    def __post_init__(self):
        n = len(self.alphabet)
        if not isinstance(self.subst_probs, (list, tuple)):
            rate = float(self.subst_probs)
            if not 0 <= rate < 1:
                raise ValueError("the substitution rate must lie in [0, 1)")
            self.subst_probs = [[1 - rate if i == j else rate / (n - 1) for j in range(n)] for i in range(n)]
        if not (0 <= self.go_prob < 1 and 0 <= self.ge_prob < 1):
            raise ValueError("gap probabilities must lie in [0, 1)")
        if self.go_prob > self.ge_prob:
            raise ValueError("the gap-open probability cannot exceed the gap-extend probability")
        if self.insert_dist is None:
            self.insert_dist = [1.0 / n] * n

    def _check_positive(self):
        if not (all(0 < p < 1 for row in self.subst_probs for p in row) and self.ge_prob > 0 and self.go_prob > 0):
            raise ValueError("scores need probabilities strictly between 0 and 1")

    def gap_scores(self):
        """Gap-open and gap-extend score: ``ln(go / ge)`` and ``ln(ge)``."""
        self._check_positive()
        return math.log(self.go_prob) - math.log(self.ge_prob), math.log(self.ge_prob)

    def log_odds_scores(self, null=None):
        """``(substitution matrix, (gap open, gap extend))`` of natural log odds
        against a letter distribution (uniform by default)."""
        self._check_positive()
        null = null or [1.0 / len(self.alphabet)] * len(self.alphabet)
        if not all(0 < q < 1 for q in null):
            raise ValueError("scores need probabilities strictly between 0 and 1")
        kept = math.log(1 - self.ge_prob)
        return ([[kept + math.log(p) - math.log(q) for p, q in zip(row, null)] for row in self.subst_probs],
                self.gap_scores())


def letter_distribution(seqs: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Share of every letter over all sequences: ``(letter, q)``. Counted per
    sequence first, so only one number per letter and task is shuffled."""
    seq = F.col("seq")
    counts = [((F.length(seq) - F.length(F.translate(seq, x, ""))).cast("bigint")) for x in alphabet.letters]
    sums = seqs.agg(*[F.sum(c).alias(f"n{k}") for k, c in enumerate(counts)])
    total = sum((F.col(f"n{k}") for k in range(len(alphabet))), F.lit(0))
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("letter"), (F.col(f"n{k}") / total).alias("q"))
        for k, x in enumerate(alphabet.letters)])).alias("e")).select("e.letter", "e.q")


def log_odds_table(model: MutationModel, null: DataFrame) -> DataFrame:
    """Substitution scores against a letter distribution kept as a DataFrame:
    ``(from_letter, to_letter, score)``, one row per pair of letters."""
    model._check_positive()
    rows = F.array(*[
        F.struct(F.lit(x).alias("from_letter"), F.lit(y).alias("to_letter"), F.lit(model.subst_probs[i][j]).alias("prob"))
        for i, x in enumerate(model.alphabet.letters) for j, y in enumerate(model.alphabet.letters)])
    return (null.withColumn("e", F.explode(F.filter(rows, lambda e: e["to_letter"] == F.col("letter"))))
            .select("e.from_letter", "e.to_letter",
                    (F.lit(math.log(1 - model.ge_prob)) + F.ln("e.prob") - F.ln("q")).alias("score")))
