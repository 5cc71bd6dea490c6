import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from kmerweave import DNA
from kmerweave.functions import stats
from kmerweave.operators import multi as M, neighbors as N, overlap as O, seeds as S, segments as G
from kmerweave.operators.components import connected_components
from kmerweave.operators.peaks import find_peaks
from kmerweave.plans import similarity, variants


def seqs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, seq string")


def rand(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def mutate(rng, text, p):
    return "".join(rng.choice("ACGT") if rng.random() < p else c for c in text)


def test_radii(spark):
    assert stats.band_radius_value(50, .1, .99) == 6
    for e in (1e-1, 1e-4, 1e-10):
        assert math.erfc(stats.erfcinv(e)) == pytest.approx(e, rel=1e-9)
    for bad in ((0, .9), (.1, 1)):
        with pytest.raises(ValueError):
            stats.band_constant(*bad)
    ratio = [stats.band_radius_value(k, .1, .99) / math.sqrt(k) for k in range(200, 2000, 200)]
    assert max(ratio) - min(ratio) < .1
    assert 0 < stats.time_in_band(100, .1, 3) < stats.time_in_band(100, .1, 6) < 1
    z = spark.range(1).select(*stats.score_num_seeds(F.lit(5), F.lit(0), F.lit(9), F.lit(1.0), 4, 6)).first()
    assert z[0] == z[1] == float("-inf")
    p = spark.range(1).select(stats.match_probability(F.lit(0), F.lit(100), F.lit(10), 4, 3).alias("a"),
                              stats.match_probability(F.lit(100), F.lit(0), F.lit(10), 4, 3).alias("b")).first()
    assert tuple(p) == (0.0, 1.0)


def test_peaks(spark):
    def series(n, hot):
        return [100 if k in hot else k for k in range(n)]
    cases = {0: series(9, {4}), 1: series(17, {4, 12}), 2: series(14, {4, 8}), 3: series(5, {0, 1})}
    rows = [(k, i, float(x), len(xs)) for k, xs in cases.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "seq_id int, idx int, x double, n int")
    got = {}
    for r in find_peaks(df, 100, 3).orderBy("seq_id", "left").collect():
        got.setdefault(r.seq_id, []).append((r.left, r.right))
    assert got == {0: [(3, 5)], 1: [(3, 5), (11, 13)], 2: [(3, 9)], 3: [(0, 2)]}


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + \
        [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    want = {x: find(x) for x in parent if find(x) != x}
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(16)
    assert {r.u: r.root for r in connected_components(df).collect()} == want


def brute_segments(seeds, s_len, t_len, r, k, p_min, w, at_least_one=False):
    """Seeds ``(kmer, i, j)`` of one pair, searched one by one."""
    seeds = sorted(seeds)
    at = [(i - j, i + j) for _, i, j in seeds]
    near = [[y for y in range(len(at)) if y != x and abs(at[x][0] - at[y][0]) <= r and abs(at[x][1] - at[y][1]) <= k]
            for x in range(len(at))]
    def p_of(n):
        word = (n + 1 - 2 * r * k * 0.25 ** w) / k
        return min(1.0, word ** (1 / w)) if word > 0 else 0.0
    ps = [p_of(len(n)) for n in near]
    free = {x for x in range(len(at)) if ps[x] >= p_min}
    if not free and at_least_one:
        free = {max(range(len(at)), key=lambda x: (ps[x], -x))}
    out = []
    while free:
        first = min(free)
        group, todo = set(), [first]
        free.discard(first)
        while todo:
            x = todo.pop()
            group.add(x)
            for y in near[x]:
                if y in free:
                    free.discard(y)
                    todo.append(y)
        ds, as_ = [at[x][0] for x in group], [at[x][1] for x in group]
        box = (min(s_len, max(min(ds) - r, -t_len)), min(s_len, max(max(ds) + r, -t_len)),
               max(min(as_) - k, 0), min(max(as_) + k, s_len + t_len))
        n = sum(box[0] <= d <= box[1] and box[2] <= a <= box[3] for d, a in at)
        out.append((*box, n, round((sum(ps[x] for x in group) + ps[first]) / (len(group) + 1), 9)))
    return sorted(out)


@pytest.mark.parametrize("low_complexity", [False, True])
def test_segments_against_search(spark, low_complexity):
    rng = random.Random(6)
    core = rand(rng, 60)
    s_texts = [rand(rng, 80) + core + rand(rng, 40), "A" * 50 + rand(rng, 30) + "A" * 40 if low_complexity else rand(rng, 100)]
    t_texts = [mutate(rng, core, .05) + rand(rng, 90) + mutate(rng, core, .1), "A" * 45 + rand(rng, 60)]
    s, t = seqs(spark, *s_texts), seqs(spark, *t_texts)
    w, k, r, p_min = 4, 12, stats.band_radius_value(12, .2, .9), .7
    seeds = S.seeds_between(s, t, DNA, w)
    scored = G.score_seeds(seeds, k, .2, .9, 4, w)
    rows = scored.collect()
    assert len(rows) == seeds.count()
    for x, y in itertools.product(range(2), range(2)):
        mine = [q for q in rows if (q.s_id, q.t_id) == (x, y)]
        for q in mine:
            assert q.n_neigh == sum(abs(q.d - z.d) <= r and abs(q.a - z.a) <= k for z in mine) - 1
    for lowest, always in ((p_min, False), (1.01, True)):
        got = G.similar_segments(seeds, s, t, k_min=k, p_min=lowest, g_max=.2, sensitivity=.9, n_letters=4, wordlen=w,
                                 at_least_one=always).collect()
        for x, y in itertools.product(range(2), range(2)):
            want = brute_segments([(q.kmer, q.i, q.j) for q in rows if (q.s_id, q.t_id) == (x, y)],
                                  len(s_texts[x]), len(t_texts[y]), r, k, lowest, w, always)
            mine = sorted((q.d_min, q.d_max, q.a_min, q.a_max, q.n_seeds, round(q.p, 9)) for q in got if (q.s_id, q.t_id) == (x, y))
            assert mine == want


def test_planted_similarity_is_one_segment(spark):
    rng = random.Random(7)
    core = rand(rng, 500)
    s, t = seqs(spark, core + rand(rng, 1500)), seqs(spark, mutate(rng, core, .05) + rand(rng, 1500))
    got = G.similar_segments(S.seeds_between(s, t, DNA, 8), s, t, k_min=300, p_min=.8, g_max=.2, sensitivity=.99,
                             n_letters=4, wordlen=8).collect()
    assert len(got) == 1 and got[0].d_min < 10 and got[0].d_max > -10 and got[0].a_min < 500
    assert .76 < got[0].p < 1.0 and got[0].z_h0 > 5


def test_overlap_band(spark):
    rng = random.Random(8)
    core = rand(rng, 400)
    reads = seqs(spark, rand(rng, 600) + core, mutate(rng, core, .05) + rand(rng, 600), rand(rng, 1000), "A" * 300 + core)
    seeds = S.seeds_within(reads, DNA, 8)
    model = dict(g_max=.2, sensitivity=.99)
    via_seeds = O.best_overlap_band(seeds, reads, reads, n_letters=4, wordlen=8, **model)
    via_runs = O.best_overlap_within(reads, DNA, 8, **model)
    rows = {(r.s_id, r.t_id): r for r in via_runs.collect()}
    assert rows == {(r.s_id, r.t_id): r for r in via_seeds.collect()}
    best = rows[0, 1]
    assert best.d_lo < 600 < best.d_hi and best.p > .85
    assert rows[0, 2].p < best.p
    r = {(q.s_id, q.t_id, q.d): q for q in O.score_seeds(seeds, reads, reads, n_letters=4, wordlen=8, **model).collect()}
    for (x, y, d), q in list(r.items())[::37]:
        near = [z for z in r.values() if (z.s_id, z.t_id) == (x, y) and abs(z.d / z.r - d / q.r) <= 1]
        assert q.n_band >= len(near)


def test_diagonals_of_all_pairs_are_not_shuffled(spark):
    reads = spark.createDataFrame([(k, "ACGTTGCAAC" * 6 + "ACGGT" * k) for k in range(1, 9)], "seq_id bigint, seq string")
    found = O.best_overlap_within(reads, DNA, 8, g_max=0.2, sensitivity=0.99)
    plan = found._jdf.queryExecution().executedPlan().toString()
    after = plan[:plan.index("SortMergeJoin" if "SortMergeJoin" in plan else "HashJoin")]
    assert after.count("Exchange hashpartitioning") == 1
    assert found.count() == 28


def test_copies_of_an_id_count_their_seeds_once(spark):
    rows = [(1, "ACGTTGCAACGGTACC" * 3), (2, "ACGTTGCAACGGTACC" * 2 + "TTGACA"), (3, "GGTACCACGTTGCAACG")]
    model = dict(g_max=0.2, sensitivity=0.99)
    for more in ([rows[1]], [(2, "ACGTTGCAACGGTACCA")], [(2, None), (None, rows[0][1])]):
        reads = spark.createDataFrame(rows + more, "seq_id bigint, seq string")
        seeds = S.seeds_within(reads, DNA, 8)
        wanted = O.best_overlap_band(seeds, reads, reads, n_letters=4, wordlen=8, **model).collect()
        found = O.best_overlap_within(reads, DNA, 8, **model).collect()
        assert len(wanted) == 3 and sorted(map(tuple, found)) == sorted(map(tuple, wanted))


def test_run_histogram_in_low_complexity(spark):
    reads = seqs(spark, "A" * 40 + "CG" * 10, "T" + "A" * 25 + "CGCG" + "A" * 9, "A" * 12, "CGT" * 12 + "CG" * 12,
                 "CGCGCGTCGTCGT" * 4 + "CGT" * 6, "ACGCG" * 8)
    def key(r):
        return r.s_id, r.t_id, r.d, r.n, tuple(r.first)
    for w in (3, 5):
        runs = O.diagonal_histogram_within(reads, DNA, w).collect()
        seeds = O.diagonal_histogram(S.seeds_within(reads, DNA, w)).collect()
        assert sorted(map(key, runs)) == sorted(map(key, seeds))


def test_groups_find_the_shared_part(spark):
    rng = random.Random(9)
    core = rand(rng, 120)
    texts = [mutate(rng, core, .01) + rand(rng, 100) for _ in range(3)]
    groups = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "group_id bigint, ord int, seq string")
    seeds = M.seeds_multi(groups, DNA, 5)
    scored = M.score_seeds_multi(seeds, 60, .1, .99, 4, 5).collect()
    r, ar = stats.band_radius_value(60, .1, .99), math.ceil(3 * 60 / 2)
    for q in scored:
        assert q.n_neigh == sum(all(abs(x - y) <= r for x, y in zip(q.ds, z.ds)) and abs(q.a - z.a) <= ar for z in scored) - 1
    got = M.similar_segments_multi(groups, DNA, 5, k_min=60, p_min=.75, g_max=.1, sensitivity=.99).collect()
    assert len(got) == 1 and got[0].a_min == 0 and got[0].p > .75
    assert all(x.lo <= 0 <= x.hi for x in got[0].d_ranges)
    assert M.similar_segments_multi(groups, DNA, 5, k_min=60, p_min=1.01, g_max=.1, sensitivity=.99, at_least_one=True).count() == 1


def test_seeds_of_a_repetitive_group_are_not_paired(spark):
    groups = spark.createDataFrame([(1, k, "A" * 12) for k in range(5)], "group_id bigint, ord int, seq string")
    r, ar = stats.band_radius_value(4, .1, .99), math.ceil(5 * 4 / 2)
    seeds = M.seeds_multi(groups, DNA, 6)
    got = {tuple(q.idxs): q.n_neigh for q in M.score_seeds_multi(seeds, 4, .1, .99, 4, 6).select("idxs", "n_neigh").collect()}
    assert len(got) == 7 ** 5
    every = np.array(sorted(got))
    ds, a = every[:, :1] - every[:, 1:], every.sum(axis=1)
    for k in random.Random(3).sample(range(len(every)), 40):
        near = (np.abs(ds - ds[k]) <= r).all(axis=1) & (np.abs(a - a[k]) <= ar)
        assert got[tuple(every[k])] == near.sum() - 1
    found = M.similar_segments_multi(groups, DNA, 6, k_min=4, p_min=.1, g_max=.1, sensitivity=.99).collect()
    assert [(q.n_qualified, q.n_seeds) for q in found] == [(7 ** 5, 7 ** 5)]


def test_neighbors_of_some_seeds_of_a_word(spark):
    groups = spark.createDataFrame([(g, k, "ACGTACGTAC"[k:] + "AAAA") for g in (1, 2) for k in range(3)],
                                   "group_id bigint, ord int, seq string")
    seeds = M.seeds_multi(groups, DNA, 2).where("group_id = 2 OR (idxs[0] + idxs[2]) % 3 > 0")
    r, ar = stats.band_radius_value(4, .1, .99), math.ceil(3 * 4 / 2)
    scored = M.score_seeds_multi(seeds, 4, .1, .99, 4, 2).collect()
    assert len(scored) == seeds.count() > 100
    for q in scored:
        assert q.n_neigh == sum(q.group_id == z.group_id and all(abs(x - y) <= r for x, y in zip(q.ds, z.ds))
                                and abs(q.a - z.a) <= ar for z in scored) - 1


@pytest.mark.parametrize("n", [3, 5])
def test_cells_connect_what_seeds_connect(spark, n):
    rng, r, ar = random.Random(n), 2, 4
    spots = sorted({(rng.randrange(2), *(rng.randrange(7 if n == 5 else 26) for _ in range(n))) for _ in range(260)})
    rows = [(g, n, 0, list(x), [x[0] - y for y in x[1:]], sum(x), ar, 1.) for g, *x in spots]
    good = spark.createDataFrame(rows, "group_id bigint, n_seqs bigint, kmer bigint, idxs array<int>, ds array<int>, a bigint, "
                                 "a_r int, p double")
    cells, members = M._cells_of(good, r, range(n - 1), p_sum=F.sum("p"))
    roots = {q.u: q.root for q in connected_components(M._linked_cells(cells, members, r)).collect()}
    placed = members.join(cells.select("u", "group_id"), "u").collect()
    got = {}
    for q in placed:
        got.setdefault(roots.get(q.u, q.u), set()).add((q.group_id, *q.ds, q.a))
    left, want = {(g, *ds, a) for g, _, _, _, ds, a, _, _ in rows}, set()
    while left:
        todo = [left.pop()]
        whole = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if x[0] == y[0] and all(abs(b - c) <= r for b, c in zip(x[1:-1], y[1:-1])) and abs(x[-1] - y[-1]) <= ar}
            left -= near
            whole |= near
            todo += near
        want.add(frozenset(whole))
    assert len(want) > 3 and set(map(frozenset, got.values())) == want


def test_repeats_and_variants(spark):
    rng = random.Random(10)
    unit, ref = rand(rng, 120), rand(rng, 600)
    own = seqs(spark, rand(rng, 80) + unit + rand(rng, 90) + unit)
    got = similarity.repeats(own, DNA, 8, k_min=60, p_min=.8, g_max=.1, sensitivity=.9).collect()
    assert len(got) == 2 and {(g.d_min < 210 < g.d_max) or (g.d_min < -210 < g.d_max) for g in got} == {True}
    reads = seqs(spark, ref[100:400], ref[100:250] + ref[350:500], ref[100:300] + rand(rng, 120) + ref[300:500])
    s = seqs(spark, ref)
    seg = G.similar_segments(S.seeds_between(s, reads, DNA, 8), s, reads, k_min=50, p_min=.8, g_max=.05, sensitivity=.9,
                             n_letters=4, wordlen=8)
    calls = {r.t_id: r for r in variants.call_variants(seg, reads, margin=60).collect()}
    assert not calls[0].deletion and not calls[0].insertion
    assert calls[1].deletion and abs(calls[1].del_from - 250) < 60 and abs(calls[1].del_to - 350) < 60
    assert calls[2].insertion and abs(calls[2].ins_at - 300) < 40


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_seeds_are_not_shuffled_again_by_pair(spark):
    s = spark.createDataFrame([(1, "ACGTTGCAAC"), (2, "TTGCAACGGT")], "seq_id bigint, seq string")
    t = spark.createDataFrame([(7, "ACGTTGCAACGGT"), (8, "TTTTTTTTTT"), (None, "GCAACGG")], "seq_id bigint, seq string")
    found = G.score_seeds(S.seeds_between(s, t, DNA, 4), 5, .2, .99, 4, 4)
    assert _exchanges(found) == 1  # of the sequences, before they are scanned


def test_neighbour_edges_cross_tiles_once(spark):
    rnd = random.Random(3)
    spots = sorted({(rnd.randrange(120), rnd.randrange(120)) for _ in range(400)})
    seeds = spark.createDataFrame([(1, 2, i, j, i - j, i + j) for i, j in spots],
                                  "s_id bigint, t_id bigint, i int, j int, d int, a int")
    found = N.neighbor_edges(seeds, 2, 3)
    got = sorted(tuple(r) for r in found.select("i", "j", "d", "a", "n_i", "n_j", "n_d", "n_a").collect())
    assert got == sorted((i, j, i - j, i + j, x, y, x - y, x + y) for i, j in spots for x, y in spots if (i, j) != (x, y)
                         and abs(i - j - x + y) <= 2 and abs(i + j - x - y) <= 3)
    # Tiles are wider than the reach on both sides, so a seed lies in few of them.
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "/ cast(8 as double)" in plan and "/ cast(24 as double)" in plan


def test_labels_and_bands_read_one_histogram(spark, tmp_path, monkeypatch):
    """Curves find seeds once, not once for the bands, once for the labels and all again for the grid."""
    from kmerweave.plans import catalogue
    texts = ["acgtacgtaaccggttacgatcgatcgatt", "ttgacca" * 9]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, "gattaca" * k + texts[k % 2] + "ccat" * k) for k in range(12)], "doc_id bigint, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    calls, seeds = [], catalogue._doc_seeds
    monkeypatch.setattr(catalogue, "_doc_seeds", lambda *a: calls.append(a) or seeds(*a))
    for run in (catalogue.roc, catalogue.ppv_npv):
        calls.clear()
        assert run(spark, str(tmp_path)).count() == 200 and len(calls) == 1


def test_bands_of_all_pairs_come_in_parts(spark, monkeypatch):
    """A task takes some pairs of runs at a time, a pair's diagonals in parts, and no window or join follows the join of runs."""
    rng = random.Random(12)
    texts = ["A" * rng.randrange(20) + rand(rng, 60) + "AC" * rng.randrange(12) + rng.choice(["", "CGT" * 9, "A" * 30]) for _ in range(9)]
    rows = [*enumerate(texts), (3, texts[3]), (4, None)]
    reads = spark.createDataFrame(rows, "seq_id bigint, seq string")
    model = dict(g_max=.2, sensitivity=.99)
    for order in ("kmer", "position"):
        wanted = {tuple(r) for r in O.best_overlap_band(S.seeds_within(reads, DNA, 4), reads, reads, n_letters=4, wordlen=4, order=order, **model).collect()}
        found = O.best_overlap_within(reads, DNA, 4, order=order, **model)
        plan = found._jdf.queryExecution().executedPlan().toString()
        after = plan[:plan.index("SortMergeJoin" if "SortMergeJoin" in plan else "HashJoin")]
        assert "Window" not in after and "Aggregate" not in after
        assert {tuple(r) for r in found.collect()} == wanted and len(wanted) > 20
        met = O._met_runs(reads, DNA, 4, (), O._LENGTHS).na.fill(1 << 30, ["s_len", "t_len"]).select("s_id", "t_id", *O._RUNS).sort(
            "s_id", "t_id", "s_len", "t_len").toArrow()
        parts = {}
        for taken, diagonals in ((1 << 16, 1 << 19), (7, 5)):
            monkeypatch.setattr(O, "TAKEN", taken)
            monkeypatch.setattr(O, "DIAGONALS", diagonals)
            bands = O._banded(T.StructType.fromDDL("s_id long, t_id long, d int, r int, len int, p double, n_seeds long"),
                              order=order, n_letters=4, wordlen=4, **model)(met.to_batches(max_chunksize=3))
            parts[taken] = [tuple(r.values()) for b in bands for r in b.to_pylist()]
        assert parts[7] == parts[1 << 16] and {r[:2] for r in parts[7]} == {r[:2] for r in wanted}
