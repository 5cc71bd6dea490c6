"""Quality, toxicity and mixing of documents."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from kmerweave.llm import mixing, quality, toxicity


def plain_measures(text):
    text = text or ""
    words = text.encode().split()
    grams = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if grams[tuple(words[k:k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered))


def test_measures_match_brute_force(odd_docs, odd_rows, no_docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = quality.measures(odd_docs).select("doc_id", *names).collect()
    assert Counter(map(tuple, found)) == Counter((r[0], *plain_measures(r[1])) for r in odd_rows)
    assert quality.judged(no_docs).collect() == []


def test_repeated_lines_and_words_of_a_text():
    text = "a b c d e f a b c d e\nx y\nx y\n\n \nx y\n"
    assert quality.measure(text.encode())[4] == 2
    assert quality.measure(text.encode())[5] == plain_measures(text)[4] == 10


def test_expectation_maximisation_finds_the_bad_and_trusts_good_rules():
    rnd = np.random.default_rng(0)
    good = rnd.random(6000) < 0.8
    right = [0.95, 0.9, 0.85, 0.6]
    votes = np.array([np.where(rnd.random(6000) < r, np.where(good, 1, -1), np.where(good, -1, 1)) for r in right]).T
    votes[rnd.random(votes.shape) < 0.1] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit(patterns, counts.astype(float))
    assert model.prior == pytest.approx(0.8, abs=0.05)
    assert model.on_good[0] == pytest.approx(0.95, abs=0.04) and 1 - model.on_bad[0] == pytest.approx(0.95, abs=0.06)
    assert quality.fit(np.zeros((0, 4)), np.zeros(0)).prior == 0.5


def test_odd_documents_are_all_judged(odd_docs, odd_rows):
    judged = quality.judged(odd_docs).collect()
    assert len(judged) == len(odd_rows) and all(0 <= r.p_good <= 1 for r in judged)
    assert all(v == 0 for r in judged if r.n_words == 0 for v in r.votes)


def test_learns_what_is_toxic_and_leaves_held_out_rows_alone(spark, odd_docs, no_docs):
    rnd = np.random.default_rng(1)
    rows = []
    for n in range(600):
        words = [f"w{int(x)}" for x in 200 * rnd.random(40) ** 2]
        bad = n % 4 == 0
        if bad:
            words[n % 40] = ["nasty", "vile"][n % 8 // 4] + "!"
        rows.append((n, " ".join(words), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(docs, toxicity.learnable(docs))
    scored = toxicity.score(docs, model).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == r.toxic for r in held]) > 0.97
    assert len(model.at) < 500
    out = toxicity.score(odd_docs, model)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.score(no_docs, model).collect() == []
    empty = toxicity.train(docs, toxicity.learnable(docs.where("false")))
    assert {r.score for r in toxicity.score(docs, empty).collect()} == {0.5}


def test_labels_may_be_null_or_repeat(spark):
    docs = spark.createDataFrame([(1, "good"), (2, "bad"), (None, "bad"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (3, None), (9, 1)], "doc_id bigint, label int")
    toxicity.train(docs, labels)


def plain_targets(sizes):
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    left, open_, target = sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s] + 1e-9}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1000, "d": 5}, {"a": 1, "b": 1, "c": 1}, {"a": 7}, {"a": 0, "b": 4}])
def test_targets_match_resharing(spark, sizes):
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "key string, size bigint")).collect()
    assert {r.key: r.target for r in found} == pytest.approx(plain_targets(sizes))


def test_mix_matches_sql_and_comes_near_targets(odd_docs, odd_rows, no_docs):
    mixed = mixing.assign(odd_docs)
    assert sorted(mixed.columns) == sorted(odd_docs.columns)
    rows = mixed.select("doc_id", "text", "source", "mix.size", "mix.source_size", "mix.target", "mix.taken").collect()
    assert len(rows) == len(odd_rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r[:3]) for r in odd_rows])
    wanted = con.execute(mixing.SQL).fetchall()
    found = mixing.summed(mixing.curriculum(mixing.sizes(odd_docs), size_col="size", mix_col="mix")).collect()
    rounded = lambda r: tuple(x if x is None else round(x, 6) for x in r)
    assert Counter(map(rounded, found)) == Counter(map(rounded, wanted))
    assert sum(r.taken for r in found) == sum(r.taken for r in rows)
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mixing.assign(no_docs).collect() == [] and mixing.curriculum(no_docs).collect() == []


def test_small_buckets_give_the_same_mix(odd_docs, monkeypatch):
    rows = lambda: sorted(map(str, mixing.assign(odd_docs).select("doc_id", "text", "mix").collect()))
    before = rows()
    monkeypatch.setattr(mixing, "BUCKET", 3)
    assert rows() == before


def test_slopes_decide_the_rows(spark, monkeypatch):
    rows = [(n, "word " * (1 + n % 9), f"s{n % 3}") for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = lambda: {r.doc_id: r for r in mixing.summed(mixing.curriculum(docs, mix_col="mix")).collect()}
    before = taken()
    monkeypatch.setattr(mixing, "SLOPES", (0.0, 0.0, 0.0))
    after = taken()
    assert before.keys() == after.keys() == set(range(60))
    assert {k: r.taken for k, r in before.items()} == {k: r.taken for k, r in after.items()}
    assert any(r.first_position != after[k].first_position for k, r in before.items())
    assert all((r.taken == 0) == (r.first_position is None) for r in before.values())


def test_curriculum_follows_the_schedule(spark):
    """Up to any time, a source has given what its integrated schedule asks for, to within a document."""
    rows = [(n, "word " * 10, f"s{n % 3}") for n in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.curriculum(docs).collect()
    positions = [r.position for r in found]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    for k, slope in enumerate(mixing.SLOPES):
        mine = [r.position for r in found if r.source == f"s{k}"]
        target = 9000 * (k + 1) / 6
        for t in (0.25, 0.5, 0.75, 1.0):
            demand = target * ((1 - slope) * t + slope * t * t)
            assert abs(10 * sum(p <= t for p in mine) - demand) <= 20


