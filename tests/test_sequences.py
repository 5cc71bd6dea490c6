import pytest
from pyspark.sql import functions as F

from kmerweave import Alphabet, DNA
from kmerweave.functions import coords
from kmerweave.functions.alphabet import content_id, same_sequence


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_alphabet_rules():
    with pytest.raises(ValueError):
        Alphabet(["00", "01", "1"])
    assert len(Alphabet(["00", "01", "10", "11"])) == 4
    assert Alphabet("ACGT") != Alphabet("AGCT") and Alphabet("ACGT") == DNA
    assert DNA[2] == "G" and "A" in repr(DNA)


def test_parse_and_identity(spark):
    s = F.lit("AACTTCG")
    row = one(spark, DNA.indices(s), content_id(s), DNA.length(s), DNA.from_indices(DNA.indices(s)),
              same_sequence(s, F.lit("AACTTCG")), DNA.letter_index(F.lit("G")))
    assert row.c0 == [0, 0, 1, 3, 3, 1, 2]
    assert row.c1 == "d9f235b1a44358cc80237d5e5c46c06d81a83e46"
    assert (row.c2, row.c3, row.c4, row.c5) == (7, "AACTTCG", True, 2)


def test_wide_letters(spark):
    wide = Alphabet(["00", "01", "11"])
    row = one(spark, wide.substitute(F.lit("0001"), {"00": "01"}), wide.substitute(F.lit("0001"), [("00", "01")]),
              wide.substitute(F.lit("0001"), [(0, 1)]), wide.substitute(F.lit("0011"), {"00": "01"}),
              wide.reverse(F.lit("0011")))
    assert tuple(row) == ("0101", "0100", "0100", "0111", "1100")
    four = Alphabet(["00", "01", "10", "11"])
    assert one(spark, four.indices(F.lit("001011"))).c0 == [0, 2, 3]
    for bad in ("000", "0x"):
        with pytest.raises(Exception):
            one(spark, four.indices(F.lit(bad)))
    with pytest.raises(Exception):
        one(spark, DNA.letter_index(F.lit("N")))


def test_slices_and_reverse_complement(spark):
    coin = Alphabet("HT")
    row = one(spark, coin.slice(F.lit("HTHT"), 0, 1), F.concat(F.lit("HTHT"), F.lit("TT")),
              DNA.reverse_complement(F.lit("AACG")), DNA.letter_at(F.lit("AACG"), 3))
    assert tuple(row) == ("H", "HTHTTT", "CGTT", 2)


def test_long_sequence_is_validated_without_recursion(spark):
    assert one(spark, F.size(DNA.indices(F.repeat(F.lit("ACGT"), 50_000)))).c0 == 200_000


def test_diagonal_coordinates(spark):
    for (i, j), want in {(0, 0): (0, 0), (0, 1): (-1, 1), (1, 0): (1, 1), (1, 1): (0, 2)}.items():
        d, a = coords.to_diagonal(F.lit(i), F.lit(j))
        back_i, back_j = coords.to_ij(d, a)
        assert tuple(one(spark, d, a, back_i, back_j)) == (*want, i, j)
    (i0, i1), (j0, j1) = coords.box_to_ij(F.lit(-2), F.lit(2), F.lit(0), F.lit(2))
    assert tuple(one(spark, i0, i1, j0, j1)) == (0, 2, 0, 2)
    assert tuple(one(spark, *coords.to_ij(F.lit(-1), F.lit(0)))) == (-1, 0)


def test_multi_coordinates(spark):
    for idxs, ds, a in (((0, 0, 1), [0, -1], 1), ((1, 0, 0), [1, 1], 1), ((1, 0, 1), [1, 0], 2), ((1, 1, 1), [0, 0], 3)):
        got_ds, got_a = coords.to_diagonal_multi(F.array(*[F.lit(x) for x in idxs]))
        row = one(spark, got_ds, got_a, coords.to_positions_multi(got_ds, got_a))
        assert (row.c0, row.c1, row.c2) == (ds, a, list(idxs))
    band = (F.lit(-2), F.lit(2))
    ranges = coords.box_to_ranges_multi([band, band], (F.lit(0), F.lit(2)))
    assert tuple(one(spark, *[x for r in ranges for x in r])) == (0, 2) * 3
