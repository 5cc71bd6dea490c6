"""Circulant MinHash against brute force."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kmerweave.llm import circulant
from kmerweave.llm.queries import op11_circulant


def shingles(text, size=2):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def plain(rows, percent=80):
    """Every row with its number of shingles and the smallest id in reach, by comparing all pairs."""
    sets, reach = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                reach[max(root(a), root(b))] = min(root(a), root(b))
    lowest = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[root(k)] = min(lowest.get(root(k), doc_id), doc_id)
    return Counter((doc_id, len(sets[k]), lowest.get(root(k)) if sets[k] else doc_id) for k, (doc_id, _) in enumerate(rows))


def edited(rnd, words, edits):
    words = list(words)
    for k in rnd.sample(range(len(words)), edits):
        words[k] = f"edit{rnd.randrange(10 ** 9)}"
    return " ".join(words)


def chains_and_groups():
    rnd, rows = random.Random(8), []
    for k in range(12):  # copies of copies: the ends of a chain are far apart
        words = [f"w{rnd.randrange(2000)}" for _ in range(120)]
        for j in range(8):
            words = edited(rnd, words, 4).split()
            rows.append((100 * k + j, " ".join(words)))
    base = [f"g{k}" for k in range(100)]  # edits of one text, each pair of them near the limit
    rows += [(5000 + k, edited(rnd, base, rnd.choice([3, 4, 5, 6, 7]))) for k in range(60)]
    short = ["a b c d e f g", "a b c d e f", "a b c d e", "A b c", "a B c", "a", "A", "b", "a b", ""]
    rows += [(9000 + k, t) for k, t in enumerate(short)]
    return rows


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert Counter(map(tuple, circulant.near_copies(odd_docs).collect())) == plain([r[:2] for r in odd_rows])
    assert circulant.near_copies(no_docs).collect() == []


def test_chains_and_groups_of_any_part_size(spark, monkeypatch):
    rows = chains_and_groups()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for part in (circulant.PART, 700):
        monkeypatch.setattr(circulant, "PART", part)
        assert Counter(map(tuple, circulant.near_copies(docs).collect())) == plain(rows)


def test_files_are_resolved_without_a_near_leader(spark):
    """A file of one leader that is near nothing, and two near groups."""
    rnd = random.Random(3)
    groups = [[f"{p}{k}" for k in range(50)] for p in "xy"]
    texts = [" ".join(f"z{k}" for k in range(55))] + [edited(rnd, g, e) for g in groups for e in (0, 1, 2, 2)]
    hashes, first = circulant.sets_of([t.encode() for t in texts], 2)
    sets = spark.createDataFrame([(k, bytearray(hashes[a:b].tobytes())) for k, (a, b) in enumerate(zip(first, first[1:]))],
                                 "content bigint, shingles binary")
    filed = spark.createDataFrame([(k, int(first[k + 1] - first[k])) for k in range(len(texts))], "content bigint, n bigint").select(
        "*", F.lit(1).cast("long").alias("file"), F.struct(F.lit(54).cast("long").alias("n"), F.lit(0).cast("long").alias("content")).alias("leader"))
    rooted = filed.select("content", F.col("content").alias("root"))
    pairs = {tuple(r) for r in circulant._links_in_open_files(filed, rooted, sets, 60).collect()}
    near = [(a, b) for a in range(len(texts)) for b in range(a) if a and b
            and 100 * len(shingles(texts[a]) & shingles(texts[b])) >= 60 * len(shingles(texts[a]) | shingles(texts[b]))]
    assert {(max(p), min(p)) for p in pairs} <= set(near) and near
    reach = {k: k for k in range(len(texts))}
    for u, v in pairs:
        reach = {k: min(reach[u], reach[v]) if r in (reach[u], reach[v]) else r for k, r in reach.items()}
    assert all(reach[a] == reach[b] for a, b in near)


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        a = rnd.integers(0, 1 << 63, 1000, dtype=np.uint64)
        b = np.concatenate([a[:int(1000 * share)], rnd.integers(0, 1 << 63, 1000 - int(1000 * share), dtype=np.uint64)])
        two = circulant.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 1000)
        assert abs((two[0] == two[1]).mean() - share / (2 - share)) < 0.06


def test_query_marks_the_first_of_each_group(spark, tmp_path):
    rows = chains_and_groups() + [(None, "no id here at all"), (None, "no id here at all")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_circulant(spark, str(tmp_path)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(rows)
