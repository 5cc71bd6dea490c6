import itertools
import random

import numpy as np
import pytest

from kmerweave import Alphabet
from kmerweave.functions import transcripts as tx
from kmerweave.operators import align as al

A = Alphabet("ACGT")
TYPES = al.STANDARD_TYPES


def run(spark, origin, mutant, kind="GLOBAL", alphabet=A, **kw):
    df = spark.createDataFrame([(origin, mutant)], "o string, m string")
    return df.select(al.align("o", "m", alphabet, kind, **kw).alias("r")).select("r.*").first()


def brute(origin, mutant, kind, match, mismatch, go, ge, band=None):
    """Independent cell-by-cell solution of the same recurrences, with scores of
    every tied operation kept as explicit lists."""
    n, m = len(origin), len(mutant)
    lo, hi = band or (-m, n)
    cells = {}
    for x, y in itertools.product(range(n + 1), range(m + 1)):
        if not lo <= x - y <= hi:
            continue
        options = []
        free = kind in ("LOCAL", "END_ANCHORED", "B_LOCAL")
        edge = kind in ("OVERLAP", "END_ANCHORED_OVERLAP", "B_OVERLAP") and 0 in (x, y)
        if free or edge or (x, y) == (0, 0):
            options.append((0.0, "B", ""))
        for op, prev in (("D", (x - 1, y)), ("I", (x, y - 1))):
            best = None
            for s, p_op, path in cells.get(prev, []):
                v = s + ge + (go if p_op != op else 0)
                if best is None or v > best[0]:
                    best = (v, op, path + op)
            if best:
                options.append(best)
        prev = cells.get((x - 1, y - 1))
        if prev:
            same = origin[x - 1] == mutant[y - 1]
            options.append((prev[0][0] + (match if same else mismatch), "P", prev[0][2] + ("M" if same else "S")))
        if options:
            top = max(o[0] for o in options)
            cells[x, y] = [o for o in options if o[0] == top]
    if kind.startswith("B_"):
        order = sorted(cells, key=lambda c: (c[0] - c[1], min(c)))
    else:
        order = sorted(cells)
    floor = 0.0 if kind in ("LOCAL", "START_ANCHORED") else float("-inf")
    best, where = floor, None
    for x, y in order:
        if kind in ("LOCAL", "START_ANCHORED", "B_LOCAL"):
            ok = True
        elif kind in ("OVERLAP", "START_ANCHORED_OVERLAP", "B_OVERLAP"):
            ok = x == n or y == m
        else:
            ok = (x, y) == (n, m)
        if ok and cells[x, y][0][0] > best:
            best, where = cells[x, y][0][0], (x, y)
    if where is None:
        return None, None
    return best, cells[where][0][2] or None


def test_global(spark):
    assert run(spark, "A" * 10, "A" * 10).transcript == "M" * 10
    r = run(spark, "A" * 10, "A" * 5)
    assert r.transcript.count("D") == 5 and len(r.transcript) == 10


def test_local_and_overlap(spark):
    o, m = "A" * 10 + "C" * 10, "C" * 10 + "A" * 10
    r = run(spark, o, m, "LOCAL", mismatch=-1, ge_score=-1)
    assert (r.transcript, r.origin_start, r.mutant_start) == ("M" * 10, 0, 10)
    r = run(spark, o, m, "OVERLAP", mismatch=-1, ge_score=-1)
    assert r.transcript == "M" * 10
    assert run(spark, "A" * 10, "C" * 10, "LOCAL").score is None


def test_banded(spark):
    assert run(spark, "A" * 10, "A" * 10, "B_GLOBAL", diag_range=(0, 0)).transcript == "M" * 10
    for band in ((-11, 0), (0, 11)):
        with pytest.raises(Exception):
            run(spark, "A" * 10, "A" * 10, "B_GLOBAL", diag_range=band)
    o, m = "A" * 10 + "C" * 10, "C" * 10 + "A" * 10
    r = run(spark, o, m, "B_OVERLAP", diag_range=(-20, 20), ge_score=-1, mismatch=-1)
    assert (r.transcript, r.score) == ("M" * 10, 10.0)
    with pytest.raises(ValueError):
        al.align("o", "m", A, "B_LOCAL")


def test_long_narrow_band(spark):
    n = 100_000
    r = run(spark, "A" * n, "C" * n, "B_GLOBAL", diag_range=(0, 0))
    assert r.transcript == "S" * n and r.score == 0


def test_frames_and_min_score(spark):
    r = run(spark, "CCAAAA", "GGGAAAA", "GLOBAL", origin_range=(2, 6), mutant_range=(3, 7))
    assert (r.transcript, r.origin_start, r.mutant_start) == ("MMMM", 2, 3)
    assert run(spark, "AC", "AC", min_score=3).score is None
    assert run(spark, "AC", "AC", min_score=2).score == 2


def test_wide_letters(spark):
    wide = Alphabet(["00", "01", "11"])
    r = run(spark, "0001", "0011", "GLOBAL", alphabet=wide, mismatch=-1, ge_score=-2)
    assert r.transcript == "MS"


@pytest.mark.parametrize("kind", al.STANDARD_TYPES + al.BANDED_TYPES)
def test_against_brute_force(spark, kind):
    rng = random.Random(kind)
    rows = []
    for k in range(60):
        o = "".join(rng.choice("ACGT"[: rng.choice((2, 4))]) for _ in range(rng.randint(0, 9)))
        m = "".join(rng.choice("ACGT"[: rng.choice((2, 4))]) for _ in range(rng.randint(0, 9)))
        if kind == "B_GLOBAL":
            lo, hi = min(0, len(o) - len(m)), max(0, len(o) - len(m))
            lo, hi = max(-len(m), lo - 1), min(len(o), hi + 1)
        else:
            lo = rng.randint(-len(m), len(o))
            hi = rng.randint(lo, len(o))
        rows.append((k, o, m, lo, hi))
    df = spark.createDataFrame(rows, "k int, o string, m string, lo int, hi int")
    banded = kind in al.BANDED_TYPES
    for match, mismatch, go, ge in ((1, 0, 0, 0), (1, -1, -1, -1), (2, -1, -3, -0.5), (1, -2, 0, -1), (1, 0, 1, -1)):
        got = df.select("k", al.align(
            "o", "m", A, kind, match=match, mismatch=mismatch, go_score=go, ge_score=ge,
            diag_range=("lo", "hi") if banded else None).alias("r")).select("k", "r.*").collect()
        for r in got:
            _, o, m, lo, hi = rows[r.k]
            want = brute(o, m, kind, match, mismatch, go, ge, (lo, hi) if banded else None)
            assert (r.score, r.transcript) == want, (rows[r.k], kind, match, mismatch, go, ge)


def test_score_matches_own_transcript(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ACGT") for _ in range(60)), "".join(rng.choice("ACGT") for _ in range(60)))
            for _ in range(10)]
    df = spark.createDataFrame(rows, "o string, m string")
    for kind in ("GLOBAL", "LOCAL", "OVERLAP"):
        kw = dict(mismatch=-1, go_score=-1, ge_score=-1)
        out = df.withColumn("r", al.align("o", "m", A, kind, **kw)).withColumn("again", tx.score(
            "r.transcript", "o", "m", "r.origin_start", "r.mutant_start",
            al.score_matrix(4, 1, -1), -1, -1, A)).collect()
        for r in out:
            assert r.again == r.r.score


def test_table_scores(spark):
    df = spark.createDataFrame([("ACG", "AC")], "o string, m string")
    got = df.select(al.table_scores("o", "m", A, ge_score=-1).alias("t")).first().t
    assert got == [[0, -1], [-1, 1], [-2, 0]]


def test_far_bands_fill_their_own_cells_only():
    """Pairs whose bands lie far apart in long tables share no rows; what is filled stays near the bands."""
    rng = np.random.default_rng(3)
    bands = np.array([(a, a + 4) for a in (-180, 0, 700, 2900)])
    origins = [rng.integers(0, 4, 3000).astype(np.uint8) for _ in bands]
    mutants = [rng.integers(0, 4, 200).astype(np.uint8) for _ in bands]
    dp = al._Group(origins, mutants, "B_LOCAL", al.score_matrix(4, 1, -1), -1.0, -0.5, bands)
    filled = sum(t.size for t in dp.ties if t is not None)
    assert filled <= 4 * 5 * 2 * (200 + 5) * len(bands)
    for r, (lo, hi) in enumerate(bands):
        alone = al._Group(origins[r:r + 1], mutants[r:r + 1], "B_LOCAL", al.score_matrix(4, 1, -1), -1.0, -0.5, bands[r:r + 1])
        score, ops, x, y = dp.result(r, 0.0)
        assert (score, ops, x, y) == alone.result(0, 0.0) and lo <= x - y <= hi


def test_tables_leave_python_in_parts(spark, monkeypatch):
    rows = [(k, "ACGTTGCA"[:k % 9], "TTGACA"[:k % 7]) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, o string, m string").coalesce(1)
    tables = lambda: df.select("k", al.table_scores("o", "m", A, mismatch=-1.0, ge_score=-1).alias("t")).collect()
    before = tables()
    monkeypatch.setattr(al, "TABLE_CELLS", 20)
    assert tables() == before
    assert [(len(r.t), [len(x) for x in r.t]) for r in before] == [(len(o), [len(m)] * len(o)) for _, o, m in rows]
