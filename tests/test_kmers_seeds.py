import itertools
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerweave import Alphabet, DNA
from kmerweave.operators import grid, kmers as K, multi as M, seeds as S
from kmerweave.operators.skew import hot_keys, salted_join, salted_sides


def seqs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, seq string")


def values(df):
    return [r.kmer for r in df.orderBy("pos").collect()]


def pairs(df):
    return sorted((r.i, r.j) for r in df.collect())


def test_words(spark):
    kmers = K.kmer_scan(seqs(spark, "AAACGCGT"), DNA, 3)
    assert values(kmers) == [0, 1, 6, 25, 38, 27]
    assert [r.kmer for r in K.distinct_kmers(kmers).orderBy("kmer").collect()] == [0, 1, 6, 25, 27, 38]
    assert [tuple(r) for r in K.kmer_hits(kmers, 27).collect()] == [(0, 5)]
    assert spark.range(1).select(K.kmer_value(F.lit("AGA"), DNA)).first()[0] == 8
    assert K.kmer_scan(seqs(spark, "", "A", "AC"), DNA, 3).count() == 0


def test_word_limits():
    for alphabet, w in ((DNA, 32), (Alphabet([f"{k:02}" for k in range(37)]), 2), (DNA, 0)):
        with pytest.raises(ValueError):
            K.check_word_length(alphabet, w)
    K.check_word_length(DNA, 31)


@pytest.mark.parametrize("letters", ["0123", "012"])
def test_masks(spark, letters):
    a = Alphabet(letters)
    for w in (3, 6):
        zeros = K.kmer_scan(seqs(spark, "0" * 10), a, w, [{0}], keep_masked=True)
        assert set(values(zeros)) == {None} and zeros.count() == 11 - w
        tail = K.kmer_scan(seqs(spark, "0" * 10 + "1"), a, w, [{0}], keep_masked=True)
        assert sum(x for x in values(tail) if x is not None) == 1
        mixed = K.kmer_scan(seqs(spark, "1212221121" + "0"), a, w, [{1}, {2}, {1, 2}])
        assert mixed.count() == 1


def test_chunks_do_not_change_words(spark, monkeypatch):
    text = "".join(random.Random(1).choice("ACGT") for _ in range(500))
    whole = values(K.kmer_scan(seqs(spark, text), DNA, 7))
    monkeypatch.setattr(K, "CHUNK", 16)
    assert values(K.kmer_scan(seqs(spark, text), DNA, 7)) == whole
    assert len(whole) == 494 and max(whole) < 4 ** 7


def test_index_once_per_content(spark):
    table = seqs(spark, "ACGTAC", "ACGTAC", "GGGTAC")
    assert {r.seq_id for r in K.kmer_index(table, DNA, 3).collect()} == {0, 2}
    seen = table.where("seq_id = 0").select(F.sha1(F.col("seq").cast("binary")).alias("content_id"))
    assert [r.seq_id for r in K.not_yet_indexed(table, seen).collect()] == [2]
    arrays = {tuple(r.kmers) for r in K.kmer_arrays(table, DNA, 5).collect()}
    assert len(arrays) == 2 and all(len(x) == 2 for x in arrays)
    hist = {r.n: r.n_kmers for r in K.abundance_histogram(K.kmer_scan(table, DNA, 3)).collect()}
    assert sum(n * k for n, k in hist.items()) == 12


def test_seed_order_and_positions(spark):
    s, t = seqs(spark, "TAAGCGT"), seqs(spark, "GGCGTAA")
    got = S.seeds_between(s, t, DNA, 3).orderBy("kmer", "i", "j").collect()
    assert [(r.i, r.j) for r in got] == [(4, 2), (3, 1), (0, 4)]
    assert [(r.d, r.a) for r in got] == [(2, 6), (2, 4), (-4, 4)]
    brute = sorted((i, j) for i in range(5) for j in range(5) if "TAAGCGT"[i:i + 3] == "GGCGTAA"[j:j + 3])
    assert pairs(S.seeds_between(s, t, DNA, 3)) == brute


@pytest.mark.parametrize("w", [5, 15])
def test_homopolymers(spark, w):
    s, t = seqs(spark, "A" * 5 * w), seqs(spark, "A" * 10 * w)
    assert S.seeds_between(s, t, DNA, w).count() == (4 * w + 1) * (9 * w + 1)
    assert S.pair_seed_counts(s, t, DNA, w).first().n_seeds == (4 * w + 1) * (9 * w + 1)
    stored = S.self_seeds(s, DNA, w)
    assert S.enumerate_seeds(stored, own=True).count() == (4 * w + 1) ** 2
    assert S.enumerate_seeds(stored, own=True, exclude_trivial=True).count() == (4 * w + 1) * 4 * w
    g, tail = seqs(spark, "G" * w), seqs(spark, "TC" + "G" * w)
    assert pairs(S.seeds_between(g, tail, DNA, w)) == [(0, 2)] and pairs(S.seeds_between(tail, g, DNA, w)) == [(2, 0)]


def test_bands(spark):
    w = 5
    seeds = S.seeds_between(seqs(spark, "T" * w + "G" * w), seqs(spark, "G" * w + "T" * w), DNA, w)
    def n(**kw):
        return S.seed_count(seeds, **kw).first().n_seeds
    assert n() == 2
    assert n(d_band=(-w - 1, -w + 1)) == 1 and n(d_band=(w - 1, w + 1)) == 1
    assert n(a_band=(w, w)) == 2
    assert S.seeds_between(seqs(spark, "T" * w + "G" * w), seqs(spark, "C" * w + "A" * w), DNA, w).count() == 0


def test_shuffled_join_equals_broadcast_join(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("AC") for _ in range(60)) for _ in range(12)] + ["A" * 200]
    t = seqs(spark, *texts)
    s = seqs(spark, *texts[:4], "A" * 80)
    by_cast = S.seeds_between(s, t, DNA, 4)
    by_shuffle = S.seeds_between(s, t, DNA, 4, allowed_memory=1e-9)
    assert by_cast.exceptAll(by_shuffle).isEmpty() and by_shuffle.exceptAll(by_cast).isEmpty()
    counts = {(r.s_id, r.t_id): r.n_seeds for r in S.pair_seed_counts(s, t, DNA, 4, allowed_memory=1e-9).collect()}
    assert counts == Counter((r.s_id, r.t_id) for r in by_cast.collect())
    within = Counter((r.s_id, r.t_id) for r in S.seeds_within(t, DNA, 4).collect())
    assert within == {(r.s_id, r.t_id): r.n_seeds for r in S.pair_seed_counts_within(t, DNA, 4).collect()}
    with pytest.raises(ValueError):
        S.fits_broadcast(s, 0)


def test_hot_keys_are_split_exactly(spark):
    """One word holds half of all rows on both sides: no cell has many more rows than a task should, and every
    pair of rows meets once."""
    limit, n = 64, 600
    left = spark.createDataFrame([(0 if k % 2 else k, k) for k in range(n)], "kmer bigint, i bigint")
    right = spark.createDataFrame([(0 if k % 2 else k % 50, k) for k in range(n)], "kmer bigint, j bigint")
    parts = {r.kmer: (r.left_parts, r.right_parts) for r in hot_keys(left, right, ["kmer"], limit).collect()}
    assert parts == {0: (5, 5)}
    for side in salted_sides(left, right, ["kmer"], ["i"], ["j"], limit):
        largest = side.groupBy("kmer", "left_salt", "right_salt").count().agg({"count": "max"}).first()[0]
        assert largest <= 1.5 * limit
    got = Counter((r.i, r.j) for r in salted_join(left, right, ["kmer"], ["i"], ["j"], limit).collect())
    want = Counter((k, m) for k in range(n) for m in range(n) if (0 if k % 2 else k) == (0 if m % 2 else m % 50))
    assert got == want


def test_self_seeds_of_a_word_that_fills_a_sequence(spark, monkeypatch):
    monkeypatch.setattr("kmerweave.operators.skew.ROWS_PER_TASK", 10)
    found = spark.createDataFrame([(1, "A" * 45), (2, "ACGT" * 4)], "seq_id bigint, seq string")
    counts = {r.s_id: r["count"] for r in S.self_seeds(found, DNA, 5).groupBy("s_id").count().collect()}
    assert counts[1] == 41 * 42 // 2

@pytest.mark.parametrize("limits", [(512, 1 << 16), (2, 3)])
def test_multi_seeds(spark, monkeypatch, limits):
    monkeypatch.setattr(M, "LIST", limits[0])
    monkeypatch.setattr(M, "RANGE", limits[1])
    w, rng = 5, random.Random(4)
    shared = "".join(rng.choice("ACGT") for _ in range(3 * w))
    texts = [shared + "".join(rng.choice("ACGT") for _ in range(20)) for _ in range(4)]
    groups = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)] + [(2, 0, "ACGTACGT"), (2, 1, "ACGTACGT")],
                                   "group_id bigint, ord int, seq string")
    got = {tuple(r.idxs) for r in M.seeds_multi(groups, DNA, w).collect()}
    def at(t, word):
        return [i for i in range(len(t) - w + 1) if t[i:i + w] == word]
    want = set()
    for word in {texts[0][i:i + w] for i in range(len(texts[0]) - w + 1)}:
        stack = [()]
        for t in texts:
            stack = [s + (i,) for s in stack for i in at(t, word)]
        want |= set(stack)
    assert got == want and {(k,) * 4 for k in range(2 * w + 1)} <= got
    n = M.seed_count_multi(M.seeds_multi(groups, DNA, w), ds_band=[(0, 0), (0, 0), None], a_band=(0, 4 * 2 * w)).first().n_seeds
    assert n == sum(1 for s in want if s[0] == s[1] == s[2] and sum(s) <= 8 * w)


def test_multi_seeds_of_repeats(spark, monkeypatch):
    """Every combination once, from several lists and ranges; one plan for groups of any size."""
    monkeypatch.setattr(M, "LIST", 3)
    monkeypatch.setattr(M, "RANGE", 10)
    groups = spark.createDataFrame([(1, k, "A" * n) for k, n in enumerate((9, 4, 12))] + [(2, k, "ACGA") for k in range(5)]
                                   + [(None, k, "AAAA") for k in range(3)], "group_id bigint, ord int, seq string")
    found = M.seeds_multi(groups, DNA, 2)
    rows = [tuple(r.idxs) for r in found.where("group_id = 1").collect()]
    assert sorted(rows) == sorted(itertools.product(range(8), range(3), range(11)))
    assert found.where("group_id = 2").count() == 3
    joins = found._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    longer = groups.unionByName(spark.createDataFrame([(3, k, "ACGA") for k in range(40)], groups.schema))
    assert M.seeds_multi(longer, DNA, 2)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == joins


def test_self_seed_sums(spark):
    found = seqs(spark, "A" * 30 + "CGAT", "ACGTACGTACG", "AC", "", "TTTTT")
    listed = {}
    for r in S.self_seeds(found, DNA, 3).collect():
        n, trivial, d, a = listed.get(r.s_id, (0, 0, 0, 0))
        listed[r.s_id] = (n + 1, trivial + (r.i == r.j), d + r.d, a + r.a)
    sums = S.self_seed_sums(found, DNA, 3)
    assert {r.s_id: (r.n_stored, r.n_trivial, r.d_total, r.a_total) for r in sums.collect()} == listed
    assert S.self_seed_sums(found, DNA, 3)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_stored_indexes_join_without_a_shuffle(spark):
    left, right = seqs(spark, "ACGTACGT", "GGGGG"), seqs(spark, "CGTACC", "GGGA", "TT")
    names = ["stored_left", "stored_right"]
    for name in names:
        K.drop_kmer_index(spark, name)
    try:
        K.save_kmer_index(K.kmer_scan(left, DNA, 3), names[0], 4)
        K.save_kmer_index(K.kmer_scan(right.where("seq_id = 0"), DNA, 3), names[1], 4)
        K.merge_kmer_index(K.kmer_scan(right.where("seq_id > 0"), DNA, 3), names[1], 4)
        joined = K.join_stored(spark, *names)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        want = S.join_kmers(K.kmer_scan(left, DNA, 3), K.kmer_scan(right, DNA, 3))
        order = ["s_id", "t_id", "i", "j"]
        assert sorted(map(tuple, joined.select(order).collect())) == sorted(map(tuple, want.select(order).collect()))
    finally:
        for name in names:
            K.drop_kmer_index(spark, name)


def test_shown_seed_sums_add_up_the_seeds(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice("ACGT"[:2 + k % 3]) for _ in range(rng.randint(0, 60)))) for k in range(20)]
    rows += [(1, rows[1][1]), (None, "AAAAAA"), (50, None), (51, "A" * 40)]
    df = spark.createDataFrame(rows, "seq_id bigint, seq string")
    shown = S.enumerate_seeds(S.self_seeds(df, DNA, 3), exclude_trivial=True, own=True).groupBy("s_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("a_total"), F.sum("d").alias("d_total"))
    found = S.shown_seed_sums(df, DNA, 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, shown.collect()))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_buckets_grow_with_the_words(spark, monkeypatch):
    df = seqs(spark, "ACGT" * 100, "", "A")
    assert K.bucket_count(df) == 8
    monkeypatch.setattr(K, "WORDS", 10)
    assert K.bucket_count(df) == 41


def test_words_are_counted_once_for_pairs_of_large_sets(spark):
    reads = spark.createDataFrame([(k, "ACGTTGCA" * 3 + "ACGGT" * k) for k in range(1, 5)], "seq_id bigint, seq string")
    for found in (S.pair_seed_counts_within(reads, DNA, 8), S.pair_seed_counts(reads, reads, DNA, 8, allowed_memory=1e-9)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan  # the join and the search for hot words read the same table of counts


def test_pair_counts_join_no_words(spark, monkeypatch):
    """Words of pairs are multiplied inside the tasks of a grid: none becomes a row of a join."""
    rng = random.Random(8)
    rows = [(k if k % 7 else None, "".join(rng.choice("ACCC") for _ in range(50))) for k in range(40)]
    s, t = (spark.createDataFrame(part + part[:2], "seq_id bigint, seq string") for part in (rows[:15], rows[10:]))
    monkeypatch.setattr(grid, "BLOCK", 300)
    found = S.pair_seed_counts(s, t, DNA, 4, allowed_memory=1e-9)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    words = {x: {i: [w for j, seq in side if j == i for w in (seq[p:p + 4] for p in range(47))] for i in {i for i, _ in side}}
             for x, side in (("s", rows[:15] + rows[:2]), ("t", rows[10:] + rows[10:12]))}
    wanted = {(i, j): sum(a.count(w) for w in b) for i, a in words["s"].items() for j, b in words["t"].items()}
    assert {(r.s_id, r.t_id): r.n_seeds for r in found.collect()} == {k: n for k, n in wanted.items() if n}


@pytest.mark.parametrize("ordered", [False, True])
def test_cells_add_up_parts(monkeypatch, ordered):
    for name, size in (("SUMS", 64), ("PRODUCTS", 16), ("TAKEN", 10)):
        monkeypatch.setattr(grid, name, size)
    for seed in range(10):
        rng = random.Random(seed)
        ids = [1, 2, 3, 5, 8, 9] + [None] * (not ordered)
        left, right = ([(w, i, rng.randrange(1, 4)) for w in range(12) for i in ids if rng.random() < 0.6] for _ in range(2))
        right.sort(key=lambda r: (r[1] is None, r[1] or 0))
        wanted = Counter()
        for w, i, n in left:
            for v, j, m in right:
                if w == v and (not ordered or i < j):
                    wanted[i, j] += n * m
        columns = zip(*[(0, 0, w, i, None, n) for w, i, n in left], *[(0, 1, w, None, j, m) for w, j, m in right], (1, 1, 0, None, 1, 1))
        table = pa.table(dict(zip(("cell", "side", "kmer", "s_id", "t_id", "n"), (pa.array(c, pa.int64()) for c in columns))))
        found = [tuple(r.values()) for b in grid._cells(ordered, ["s_id", "t_id", "n"])(table.to_batches(max_chunksize=7)) for r in b.to_pylist()]
        assert len(found) == len(wanted) and {(i, j): n for i, j, n in found} == dict(wanted)
