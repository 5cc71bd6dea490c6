"""Toxicity of documents: FTRL-proximal logistic regression over hashed words, word pairs and skip pairs.

The learner passes over a bounded sample of labelled documents, whose features Spark extracts in parallel. L1 leaves few
weights, so the model travels with the scoring function. All documents are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from kmerweave.llm.common import batch_texts, bucket_of, texts_of
from kmerweave.llm.hashing import mix, together, word_hashes

#: Hashed features; the weights have one more entry, the bias.
FEATURE_BITS = 20
#: Bound of the labelled sample: the rows with the smallest hashes of their ids.
SAMPLE = 24_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 5.0, 1.0, 5.0, 0.0

_NO_PUNCTUATION = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def _normal(text: bytes) -> bytes:
    return text.decode().lower().encode().translate(_NO_PUNCTUATION)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts and the text that each is of; a text's repeats included."""
    words, first = word_hashes([_normal(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    found, owners = [mix(words)], [owner]
    for gap in (1, 2):
        with np.errstate(over="ignore"):
            pairs = mix(words[:-gap] * np.uint64(2 * gap + 1) + mix(words[gap:]))
        inside = owner[:-gap] == owner[gap:]
        found.append(pairs[inside])
        owners.append(owner[:-gap][inside])
    return (np.concatenate(found) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), np.concatenate(owners)


@dataclass(frozen=True)
class Weights:
    """The features with a weight, their weights, and the bias."""

    at: np.ndarray
    value: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        weights = np.zeros(1 << FEATURE_BITS)
        weights[self.at] = self.value
        return weights


def ftrl(rows: list[tuple[np.ndarray, int]], epochs=EPOCHS) -> np.ndarray:
    """Weights after passes over ``rows``, each a document's distinct features and its label."""
    size = (1 << FEATURE_BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, L1)
    l1[-1] = 0.0

    def weights(at):
        return np.where(np.abs(z[at]) <= l1[at], 0.0,
                        (np.sign(z[at]) * l1[at] - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, label in rows:
            w = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            root = np.sqrt(n[at])
            n[at] += slope * slope
            z[at] += slope - (np.sqrt(n[at]) - root) / ALPHA * w
    return weights(np.arange(size))


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rank, doc_id, label, features)`` of the sample; its ids are few enough to broadcast."""
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    chosen = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(
        F.max("label").alias("label")).orderBy(order, "doc_id").limit(SAMPLE)
    rows = texts_of(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select(
        order.alias("rank"), "doc_id", "label", "text")

    def extract(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [np.unique(features([t])[0]).astype(np.int32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("rank", "doc_id", "label")), pa.array(found, pa.binary())],
                names=["rank", "doc_id", "label", "features"])

    return rows.mapInArrow(extract, "rank bigint, doc_id bigint, label int, features binary")


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, seen = [], np.zeros(1 << FEATURE_BITS, np.int32)
    for batch in batches:
        for found, label in zip(batch.column("features").to_pylist(), batch.column("label").to_pylist()):
            rows.append((np.frombuffer(found, np.int32), label))
            seen[rows[-1][0]] += 1
    # A gradient is at most 1 in size, so a document moves a feature by at most EPOCHS: L1 keeps rarer ones at zero.
    enough = seen * EPOCHS > L1
    for k, (at, label) in enumerate(rows):  # one after the other, so that the sample is not held twice
        rows[k] = (np.append(at[enough[at]], np.int32(1 << FEATURE_BITS)), label)
    if rows:
        weights = ftrl(rows)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], names=["at", "value"])


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> Weights:
    """Fits on the documents that ``labels`` ``(doc_id, label)`` marks 0 or 1, at most ``SAMPLE`` of them. Rows without
    id or label are passed over; an id with both labels counts as 1. Without any row the score is one half."""
    sampled = _sampled(docs, labels, id_col, text_col).repartition(1).sortWithinPartitions("rank", "doc_id", "features")
    weights = sampled.mapInArrow(_fit, "at bigint, value double").toArrow()  # at most one row a feature
    at, value = weights.column("at").to_numpy(), weights.column("value").to_numpy()
    bias = at == 1 << FEATURE_BITS
    return Weights(at[~bias], value[~bias], float(value[bias].sum()))


def score(docs: DataFrame, model: Weights, text_col="text", out_col="score") -> DataFrame:
    """``docs`` with ``out_col``, the probability of label 1, in place of a column of that name. An empty or null text
    has the bias alone."""
    batch_texts(docs.sparkSession)
    at, value, bias = model.at, model.value, model.bias

    @F.arrow_udf(DoubleType())
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = Weights(at, value, bias).dense()
        for column in columns:
            sums = [np.zeros(0)]
            for rows, texts in together(enumerate(column.to_pylist())):
                found, owner = features(texts)
                some = weights[found] != 0
                distinct = np.unique(owner[some] << FEATURE_BITS | found[some])
                sums.append(np.bincount(distinct >> FEATURE_BITS, weights[distinct & (1 << FEATURE_BITS) - 1],
                                        minlength=len(texts)))
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(sums) + bias, -500, 500))))

    return docs.withColumn(out_col, scored(F.coalesce(docs[text_col].cast("binary"), F.lit(b""))))


def learnable(labels: DataFrame, held_out_of=5) -> DataFrame:
    """``(doc_id, label)`` from ``labels (doc_id, toxic)`` without the fifth that is held out."""
    return labels.where(~held_out("doc_id", held_out_of)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))


def held_out(id_col: str, of=5):
    return bucket_of(id_col, of) == 0
