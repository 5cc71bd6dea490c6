import math
import random
import re

import pytest
from pyspark.sql import functions as F

from kmerweave import Alphabet, DNA
from kmerweave.functions import transcripts as X
from kmerweave.functions.mutation import MutationModel, letter_distribution, log_odds_table
from kmerweave.functions.render import render
from kmerweave.operators import evaluate as E, simulate as R, skew
from kmerweave.plans import similarity


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first())


def tx_table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, tx string")


def test_lengths_scores_and_truncation(spark):
    for tx, o, m in (("MSI", 2, 3), ("DMS", 3, 2), ("IMS", 2, 3)):
        assert one(spark, X.projected_len(F.lit(tx)), X.projected_len(F.lit(tx), "mutant")) == (o, m)
    subst = [[2.0 if i == j else -1.0 for j in range(4)] for i in range(4)]
    s = X.score(F.lit("MSDDMI"), F.lit("AACCTG"), F.lit("ATTA"), F.lit(0), F.lit(0), subst, -3, -1, DNA)
    assert one(spark, s) == (2 - 1 - 3 - 2 + 2 - 3 - 1,)
    cut = X.truncate_to_match(F.lit("SSIMMSMDD"), F.lit(4), F.lit(5))
    assert one(spark, *cut) == ("MMSM", 6, 8)
    assert one(spark, *X.truncate_to_match(F.lit("SMS"), F.lit(0), F.lit(0))) == (None, None, None)
    assert one(spark, *X.truncate_to_match(F.lit("SSD"), F.lit(0), F.lit(0))) == (None, None, None)
    assert one(spark, *X.truncate_to_match(F.lit("S" * 10 + "M" * 10), F.lit(0), F.lit(0))) == ("M" * 10, 10, 10)
    ok = [X.is_valid(F.lit(t), F.lit(a), F.lit(0), F.lit(4), F.lit(4)) for t, a in (("MMMM", 0), ("MMMM", 1), ("MX", 0), ("", 0))]
    assert one(spark, *ok) == (True, False, False, False)


def test_rendering(spark):
    def show(o, m, tx, i=0, j=0, n=1, **kw):
        return one(spark, render(F.lit(o), F.lit(m), F.lit(tx), F.lit(i), F.lit(j), n, **kw))[0]
    assert "AG-T" in show("AACT", "AGT", "MSDM", colored=False)
    assert "AAC-T" in show("AACT", "AACGT", "MMMIM", colored=False)
    assert "--11" in show("0011", "11", "DM", n=2, colored=False)
    assert "\x1b[32m" in show("AACT", "AGT", "MSDM") and "\x1b" not in show("AACT", "AGT", "MSDM", colored=False)
    lines = show("A" * 100, "A" * 100, "M" * 100, width=40, colored=False).splitlines()
    assert len(lines) % 2 == 0 and all(len(x) <= 40 for x in lines)
    assert sum(len(re.sub(r"^.*: ", "", x)) for x in lines[::2]) == 100
    assert "..ACGT" in show("ACGTAC", "TTACGTAC", "MMMM", 0, 2, margin=2, colored=False)
    with pytest.raises(ValueError):
        show("A", "A", "M", width=10)


def brute_rates(tx, r, ops):
    return [sum(c in ops for c in tx[i - r:i + r]) / (2 * r) if r <= i < len(tx) - r else 0.0 for i in range(len(tx))]


@pytest.mark.parametrize("chunk", [X.CHUNK, 5])
def test_positions_and_rates(spark, monkeypatch, chunk):
    monkeypatch.setattr(X, "CHUNK", chunk)
    text = "MMSDIMMMDDSMIIMMMSMMDM" * 2
    df = tx_table(spark, text, "MM", "")
    assert [r.p_match for r in X.match_rate(df, 3).where("seq_id = 1").collect()] == [0.0, 0.0]
    at = X.positions(df).where("seq_id = 0").orderBy("idx").collect()
    i = j = 0
    for r in at:
        assert (r.i, r.j) == (i, j)
        i, j = i + (r.op != "I"), j + (r.op != "D")
    pts = X.path(df, x0=3).where("seq_id = 0").orderBy("step").collect()
    assert len(pts) == len(text) + 1 and (pts[-1].x, pts[-1].y) == (i + 3, j)
    rates = X.match_rate(df, 3).where("seq_id = 0").orderBy("idx").collect()
    assert [r.p_match for r in rates] == pytest.approx(brute_rates(text, 3, "M"))
    gaps = X.gap_rate(df, 3).where("seq_id = 0").orderBy("idx").collect()
    assert [r.p_gap for r in gaps][3:-3] == pytest.approx([1 - x for x in brute_rates(text, 3, "MS")][3:-3])
    words = {r.idx for r in X.matching_words(df, 2).where("seq_id = 0").collect()}
    assert words == {k for k in range(len(text) - 1) if text[k:k + 2] == "MM"}
    for on, col in (("origin", "i"), ("mutant", "j")):
        last = {}
        for r in rates:
            last[r[col]] = r.p_match
        assert {r.pos: r.p_match for r in X.projected_match_rate(df, 3, on).where("seq_id = 0").collect()} == last
    assert one(spark, X.remove_long_gaps(F.lit("M" + "D" * 100 + "I" * 99 + "M")))[0] == "M" + "I" * 99 + "M"


def test_exploded_rows_are_not_shuffled(spark):
    df = tx_table(spark, "MMSD" * 50)
    for rows in (X.positions(df), X.path(df), X.match_rate(df, 8), X.matching_words(df, 3)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and plan.index("Exchange ") > plan.index("Generate posexplode")


def test_sampled_windows(spark):
    df = tx_table(spark, "MD" * 40, "M" * 80)
    got = X.sample_windows(df, 8, 6, gap=.5, resolution=.01).collect()
    few = [r for r in got if r.draw is None]
    assert [(r.seq_id, r.n_candidates, r.window) for r in few] == [(1, 0, None)]
    drawn = [r for r in got if r.draw is not None]
    assert len(drawn) == 6 and {r.seq_id for r in drawn} == {0}
    assert all(len(r.window) == 8 and r.window.count("D") == 4 for r in drawn)


def test_evaluation(spark):
    pos, neg = [.9, .8, .8, .4], [.1, .5, .3, .8, .2]
    scores = spark.createDataFrame([(x, True) for x in pos] + [(x, False) for x in neg], "score double, positive boolean")
    def cdf(sample, x):
        return 1.0 if x >= max(sample) else 0.0 if x <= min(sample) else sum(v < x for v in sample) / len(sample)
    for c in "<>":
        for r in E.roc(scores, classifier=c, num_points=50).collect():
            f, t = cdf(neg, r.threshold), cdf(pos, r.threshold)
            assert (r.fpr, r.tpr) == pytest.approx((f, t) if c == "<" else (1 - f, 1 - t))
        for r in E.predictive_values(scores, classifier=c, num_points=50).collect():
            p, n = cdf(pos, r.threshold) * 4, cdf(neg, r.threshold) * 5
            (cp, cn), (rp, rn) = ((p, n), (4 - p, 5 - n)) if c == "<" else ((4 - p, 5 - n), (p, n))
            assert r.ppv == (pytest.approx(cp / (cp + cn)) if cp + cn > 1e-12 else r.ppv)
            assert r.npv == (pytest.approx(rn / (rp + rn)) if rp + rn > 1e-12 else r.npv)
    at = spark.createDataFrame([(x,) for x in (0.0, .1, .3, .35, .8, 2.0)], "x double")
    sample = scores.where("NOT positive")
    assert {r.x: r.cdf for r in E.empirical_cdf(sample, "score", at, "x").collect()} == {x: cdf(neg, x) for x in (0.0, .1, .3, .35, .8, 2.0)}
    truth = spark.createDataFrame([("g", "a"), ("g", "b")], "k string, item string")
    calls = spark.createDataFrame([("g", "b"), ("g", "c"), ("h", "a")], "k string, item string")
    got = {r.k: (r.tp, r.fp, r.fn, r.tn, r.tpr) for r in E.rates(E.call_stats(truth, calls, 5, "k", "item")).collect()}
    assert got == {"g": (1, 1, 1, 2, .5), "h": (0, 1, 0, 4, 1.0)}
    reads = spark.createDataFrame([(1, "+", 0, 200), (2, "+", 149, 400), (3, "+", 150, 400), (4, "-", 0, 200), (5, "+", 0, 5000)],
                                  "id int, strand string, start int, stop int")
    found = {(r.id1, r.id2): r.overlap for r in E.overlapping_intervals(reads, 50, 64).collect()}
    assert found == {(1, 2): 51, (1, 5): 200, (2, 3): 250, (2, 5): 251, (3, 5): 250}


def test_piled_up_intervals(spark, monkeypatch):
    """Half of all reads at one place: cells of bounded size, the same pairs."""
    rng = random.Random(12)
    rows = [(k, rng.choice("+-"), s, s + rng.randrange(300)) for k, s in enumerate(
        [1000 + rng.randrange(3) for _ in range(60)] + [rng.randrange(3000) for _ in range(60)])]
    rows += [(3, None, 1000, 1300), (7, "+", None, None)]
    reads = spark.createDataFrame(rows, "id int, strand string, start int, stop int")
    want = {(min(a, c), max(a, c)): min(x, y) - max(s, t) for a, u, s, x in rows for c, v, t, y in rows
            if a < c and u == v and None not in (u, s, t) and min(x, y) - max(s, t) > 50}
    for limit in (4, 1 << 13):
        found = E.overlapping_intervals(reads, 50, 64, rows_per_task=limit).collect()
        assert len(found) == len(want) and {(r.id1, r.id2): r.overlap for r in found} == want
    kept = []
    monkeypatch.setattr(E, "salted_join", lambda *a: kept.append(a) or skew.salted_join(*a))
    E.overlapping_intervals(reads, 50, 64, rows_per_task=4)
    left, right = skew.salted_sides(*kept[0])
    cells = left.groupBy("strand", "bin", "left_salt", "right_salt").count().agg(F.max("count")).first()[0]
    assert cells <= 16  # about four, where all would be sixty


def test_time_in_band_tends_to_the_closed_form(spark):
    from kmerweave.functions.stats import time_in_band
    paths = X.positions(R.random_transcripts(spark, 100, 400, .2, seed=11))
    mean = E.time_in_band(paths, 8).agg(F.avg("in_band")).first()[0]
    assert abs(mean - time_in_band(400, .2, 8)) < .1
    total = E.diagonal_profile(paths).agg(F.max("upto")).first()[0]
    assert total == 100 * 400


def test_error_function_and_expected_share(spark):
    from kmerweave.functions import stats
    xs = [0.0, 1e-9, -0.3, 0.5, 1.0, 2.2, -3.3, 4.4, 5.9, 6.0, 30.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erf("x").alias("e")).collect()
    assert all(abs(r.e - math.erf(r.x)) < 1e-14 for r in rows)
    cases = [(400, .2, 8), (25_000, .1, 50), (10, .5, 30), (1, .01, 1)]
    got = spark.createDataFrame(cases, "n int, g double, r int").select("*", stats.expected_time_in_band("n", "g", "r").alias("p")).collect()
    assert all(r.p == pytest.approx(stats.time_in_band(r.n, r.g, r.r), abs=1e-12) for r in got)
    assert spark.range(1).select(stats.expected_time_in_band(F.lit(0), 0.2, 5)).first()[0] is None


def test_mutation_model(spark):
    with pytest.raises(ValueError):
        MutationModel(DNA, ge_prob=.1, go_prob=.2)
    with pytest.raises(ValueError):
        MutationModel(DNA).log_odds_scores()
    m = MutationModel(DNA, subst_probs=.1, ge_prob=.1, go_prob=.1)
    subst, (go, ge) = m.log_odds_scores()
    assert go == 0 and ge < 0 and subst[0][0] > 0 > subst[0][1]
    given = MutationModel(DNA, subst_probs=[[.7, .1, .1, .1]] * 4, ge_prob=.2, go_prob=.1)
    assert given.log_odds_scores()[0][2][0] == pytest.approx(subst[0][0] + 0.0, abs=1)
    table = spark.createDataFrame([(0, "AACG"), (1, "TTTT")], "seq_id bigint, seq string")
    q = {r.letter: r.q for r in letter_distribution(table, DNA).collect()}
    assert q == {"A": .25, "C": .125, "G": .125, "T": .5}
    scores = {(r.from_letter, r.to_letter): r.score for r in log_odds_table(m, letter_distribution(table, DNA)).collect()}
    assert len(scores) == 16
    want, _ = m.log_odds_scores([.25, .125, .125, .5])
    assert scores["A", "C"] == pytest.approx(want[0][1])


def test_reads_and_mutants(spark):
    seqs = R.random_sequences(spark, 5, 400, DNA, seed=1)
    text = {r.seq_id: r.seq for r in seqs.collect()}
    assert all(len(t) == 400 and set(t) == set("ACGT") for t in text.values()) and len(set(text.values())) == 5
    skewed = R.random_sequences(spark, 1, 2000, DNA, p=[.7, .1, .1, .1]).first().seq
    assert .6 < skewed.count("A") / 2000 < .8
    reads = R.lossless_reads(seqs, 200, expected_coverage=10).collect()
    assert len(reads) == 5 * 20 and all(text[r.seq_id][r.start:r.start + len(r.seq)] == r.seq for r in reads)
    assert {(r.seq_id, r.read, r.seq) for r in R.lossless_reads(seqs.repartition(7), 200, expected_coverage=10).collect()} == \
        {(r.seq_id, r.read, r.seq) for r in reads}
    for bad in (dict(len_mean=400), dict(len_mean=10, num=1, expected_coverage=1)):
        with pytest.raises(Exception):
            R.lossless_reads(seqs, **bad).collect()
    m = MutationModel(DNA, subst_probs=.1, ge_prob=.3, go_prob=.1)
    for r in R.mutants(seqs, m, seed=2).collect():
        i = j = 0
        for op in r.transcript:
            if op in "MS":
                assert (r.seq[i] == r.mutant[j]) == (op == "M")
            i, j = i + (op != "I"), j + (op != "D")
        assert (i, j) == (400, len(r.mutant))
        assert set(r.transcript) == set("MSID")
    same = R.mutants(seqs, MutationModel(DNA)).first()
    assert same.mutant == same.seq and same.transcript == "M" * 400
    wide = Alphabet(["00", "01", "11"])
    got = spark.createDataFrame([(0, "0001" * 30)], "seq_id bigint, seq string").withColumn(
        "m", R.mutate("seq", MutationModel(wide, subst_probs=.3, ge_prob=.2, go_prob=.2))).first().m
    assert len(got.mutant) == 2 * sum(op != "D" for op in got.transcript)
    filled = spark.range(1).select(R.fill_in_unknown(F.lit("ANNC"), DNA, 0, F.col("id"))).first()[0]
    assert re.fullmatch("A[ACGT]{2}C", filled)


def test_generated_data_sets(spark):
    ref = "A" * 50 + "C" * 50
    row = one(spark, R.structural_variant(F.lit(ref), "deletion", 40, 20),
              R.structural_variant(F.lit(ref), "duplication", 90, 5, source=0),
              R.structural_variant(F.lit(ref), "insertion", 50, 9, DNA, row="id"))
    assert row[0] == "A" * 40 + "C" * 40 and row[1] == "A" * 50 + "C" * 40 + "AAAAA" + "C" * 10
    assert len(row[2]) == 109 and row[2].startswith("A" * 50) and row[2].endswith("C" * 50)
    def covers(kind, start, length):
        return one(spark, R.covers_variant(kind, start, length, 100, 50, 10))[0]
    assert covers("insertion", 80, 100) and not covers("insertion", 120, 100)
    assert covers("deletion", 80, 40) and not covers("deletion", 120, 40) and covers("duplication", 120, 40)
    elements = R.random_sequences(spark, 6, 60, DNA, seed=5)
    text = {r.seq_id: r.seq for r in elements.collect()}
    genomes = R.planted_genomes(elements, 4, 3, DNA, spacer=20).collect()
    assert len(genomes) == 4
    for g in genomes:
        assert len(set(g.elements)) == 3 and len(g.seq) == 3 * 60 + 4 * 20
        assert all(text[e] in g.seq for e in g.elements)


def test_operations_are_not_sorted_or_joined(spark):
    df = tx_table(spark, "MMSD" * 50, "MIDS" * 30)
    for rows in (X.matching_words(df, 3), X.match_rate(df, 8), similarity.similar_regions(df, 8, .5)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
    for rows in (X.matching_words(df, 3), X.match_rate(df, 8)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
    plan = X.sample_windows(df, 8, 6, match=.25, resolution=.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_projected_rate_is_the_last_one_in_front_of_a_letter(spark, monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 8)
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("MSID") for _ in range(rng.randint(1, 90)))) for k in range(30)]
    rows += [(1, rows[1][1]), (None, "MMIID"), (None, "MMIID")]
    df = spark.createDataFrame(rows, "seq_id bigint, tx string")
    for on, at in (("origin", "i"), ("mutant", "j")):
        plain = X.match_rate(df, 2).groupBy("seq_id", F.col(at).alias("pos")).agg(F.count("idx"))
        found = X.projected_match_rate(df, 2, on).collect()
        assert sorted((r.seq_id or -1, r.pos) for r in found) == sorted((r.seq_id or -1, r.pos) for r in plain.collect())
        rates = {(r.seq_id, r[at]): r for r in X.match_rate(df, 2).orderBy("idx").collect()}
        assert all(r.p_match == rates[r.seq_id, r.pos].p_match for r in found if r.seq_id not in (1, None))


def test_sampled_windows_over_chunks(spark, monkeypatch):
    df = tx_table(spark, "MSID" * 60, "MMSD" * 5, "M")
    whole = sorted(map(str, X.sample_windows(df, 8, 6, match=.25, resolution=.01).collect()))
    monkeypatch.setattr(X, "CHUNK", 8)
    assert sorted(map(str, X.sample_windows(df, 8, 6, match=.25, resolution=.01).collect())) == whole
    assert sum("window='" in r for r in whole) == 6
