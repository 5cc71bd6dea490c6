"""The toxicity learner against a plain one, and the whole query's contract."""

import math
import random
import zlib

import numpy as np

from kmerweave.llm import toxicity
from kmerweave.llm.queries import op2_quality, op7_toxicity


def plain_ftrl(rows, epochs):
    """FTRL-proximal, a feature at a time."""
    bias, z, n = 1 << toxicity.FEATURE_BITS, {}, {}

    def weight(f):
        l1 = 0.0 if f == bias else toxicity.L1
        v = z.get(f, 0.0)
        if abs(v) <= l1:
            return 0.0
        return (math.copysign(l1, v) - v) / ((toxicity.BETA + math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for found, label in rows:
            w = {f: weight(f) for f in found}
            slope = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - label
            for f in found:
                before = n.get(f, 0.0)
                n[f] = before + slope * slope
                z[f] = z.get(f, 0.0) + slope - (math.sqrt(n[f]) - math.sqrt(before)) / toxicity.ALPHA * w[f]
    return {f: weight(f) for f in z}


def test_weights_match_a_plain_learner():
    rnd = random.Random(4)
    bias = 1 << toxicity.FEATURE_BITS
    rows = []
    for _ in range(300):
        label = rnd.randrange(2)
        found = {rnd.randrange(40) for _ in range(8)} | ({100 + rnd.randrange(3)} if label and rnd.random() < 0.9 else set())
        rows.append((np.array(sorted(found) + [bias]), label))
    got = toxicity.ftrl(rows, epochs=3)
    want = plain_ftrl([(r.tolist(), label) for r, label in rows], 3)
    assert all(abs(got[f] - w) < 1e-9 for f, w in want.items())
    assert np.flatnonzero(got).tolist() == sorted(f for f, w in want.items() if w)
    assert min(got[100:103]) > 0.5


def test_query_returns_every_document_and_learns_only_from_its_fold(spark, tmp_path):
    rnd = random.Random(5)
    plain, bad = [f"w{k}" for k in range(200)], ["vile", "scum", "filth"]
    docs, labels = [], []
    for k in range(400):
        toxic = k % 2
        words = rnd.choices(plain, k=30) + (rnd.choices(bad, k=4) if toxic else [])
        rnd.shuffle(words)
        docs.append((k, " ".join(words), "en", "s", 0))
        # Labels of the held-out fold are wrong on purpose: they must not be learned from.
        held_out = zlib.crc32(str(k).encode()) % 5 == 0
        labels.append((k, 0, 1 - toxic if held_out else toxic))
    docs += [(1000, None, "en", "s", 0), (1001, "", None, None, 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r for r in op7_toxicity(spark, str(tmp_path)).collect()}
    assert found.keys() == {d[0] for d in docs}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    right = [found[k].predicted == k % 2 for k in range(400) if found[k].held_out]
    assert sum(right) >= 0.95 * len(right)


def test_base_rules_of_the_quality_query(spark, tmp_path):
    repeated = "one two three four five six " * 4
    docs = [(1, "too few words here"), (2, repeated), (3, None), (4, " ".join(f"word{k}" for k in range(60)) + "."), (5, "a " * 9)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in op2_quality(spark, str(tmp_path)).collect()}
    assert {k: r.base_failed for k, r in found.items()} == {1: True, 2: True, 3: True, 4: False, 5: True}
    assert (found[2].n_words, found[2].n_repeat_words) == (24, 24) and not any(found[k].kept for k in (1, 2, 3, 5))
