"""Statistics of seed counts as column expressions.

Under the null model words match independently of position; under the related
model an alignment of known length and match probability runs through the
region. Both give a normal limit for the number of seeds in a region, from which
z-scores and a match-probability estimate follow. Per-query constants are
computed once on the driver; everything that depends on rows is a column.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

MACHINE_EPS = 2.220446049250313e-16


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


# -- driver-side constants ---------------------------------------------------

def erfcinv(e: float) -> float:
    """Inverse complementary error function."""
    return -NormalDist().inv_cdf(e / 2) / math.sqrt(2)


def band_constant(gap_prob: float, sensitivity: float) -> float:
    """``C`` such that a band of radius ``C * sqrt(K)`` holds an alignment of
    length ``K`` with the wanted probability."""
    if not (0 < gap_prob < 1 and 0 < sensitivity < 1):
        raise ValueError("gap probability and sensitivity must lie strictly between 0 and 1")
    return erfcinv(1.0 - sensitivity) * math.sqrt(2 * gap_prob)


def band_radius_value(length: float, gap_prob: float, sensitivity: float) -> int:
    """Band radius for one length known on the driver."""
    return max(1, math.ceil(band_constant(gap_prob, sensitivity) * math.sqrt(length)))


# -- geometry ----------------------------------------------------------------

def band_radius(length, gap_prob, sensitivity) -> Column:
    """Band radius of a column of lengths (scalar and bulk use are the same)."""
    c = F.lit(band_constant(gap_prob, sensitivity))
    return F.greatest(F.lit(1), F.ceil(c * F.sqrt(_c(length)))).cast("int")


def wall_to_wall_distance(len0, len1, d) -> Column:
    """Longest run of cells on diagonal ``d`` of a ``len0 x len1`` table."""
    len0, len1, d = _c(len0), _c(len1), _c(d)
    return F.least(len0 - d, len1) + F.least(d, F.lit(0))


def expected_overlap_len(len0, len1, d, gap_prob) -> Column:
    """Expected length of an overlap alignment on diagonal ``d``."""
    factor = F.lit(2.0 / (2.0 - gap_prob))
    return F.ceil(factor * wall_to_wall_distance(len0, len1, d)).cast("int")


def segment_dims(d_min, d_max, a_min, a_max):
    """Path length and area of a diagonal box."""
    d_min, d_max, a_min, a_max = map(_c, (d_min, d_max, a_min, a_max))
    length = F.floor((a_max - a_min) / 2)
    return length, (d_max - d_min) * length


# -- moments -----------------------------------------------------------------

def _per_position_variance(p, pw, w):
    return (1 - pw) * (pw + 2 * p * pw / (1 - p)) - 2 * w * pw * pw


def null_constants(n_letters: int, wordlen: int):
    """Mean and variance of the seed count per unit area under the null model."""
    p = 1.0 / n_letters
    pw = p ** wordlen
    return pw, _per_position_variance(p, pw, wordlen)


def h0_moments(n_letters, wordlen, area):
    """Mean and standard deviation of the seed count under the null model."""
    mean, var = null_constants(n_letters, wordlen)
    area = _c(area)
    return area * F.lit(mean), F.sqrt(area * F.lit(var))


def _add_related(mu0, var0, wordlen, length, p_match):
    length, p = _c(length), _c(p_match).cast("double")
    p = F.when(p == 1.0, F.lit(1.0 - MACHINE_EPS)).otherwise(p)
    pw = F.pow(p, F.lit(float(wordlen)))
    return mu0 + length * pw, F.sqrt(var0 + length * _per_position_variance(p, pw, wordlen))


def h1_moments(n_letters, wordlen, area, length, p_match):
    """Mean and standard deviation of the seed count under the related model."""
    mean, var = null_constants(n_letters, wordlen)
    area = _c(area)
    return _add_related(area * F.lit(mean), area * F.lit(var), wordlen, length, p_match)


def _z(n, mu, sd):
    return (_c(n) - mu) / F.when(sd != 0, sd)


def score_num_seeds(n, area, length, p_match, n_letters, wordlen):
    """z-scores of a seed count against both models; ``-inf`` for empty areas."""
    area = _c(area)
    mu0, sd0 = h0_moments(n_letters, wordlen, area)
    mu1, sd1 = h1_moments(n_letters, wordlen, area, length, p_match)
    none = F.lit(float("-inf"))
    return (F.when(area == 0, none).otherwise(_z(n, mu0, sd0)),
            F.when(area == 0, none).otherwise(_z(n, mu1, sd1)))


def score_num_seeds_multi(n, volume, length, p_match, n_letters, n_seqs, wordlen):
    """N-sequence z-scores; the null word matches in all sequences at once."""
    volume, n_seqs = _c(volume), _c(n_seqs)
    p = F.pow(F.lit(1.0 / n_letters), (n_seqs - 1).cast("double"))
    pw = F.pow(p, F.lit(float(wordlen)))
    mu0, var0 = volume * pw, volume * _per_position_variance(p, pw, wordlen)
    mu1, sd1 = _add_related(mu0, var0, wordlen, length, p_match)
    none = F.lit(float("-inf"))
    return (F.when(volume == 0, none).otherwise(_z(n, mu0, F.sqrt(var0))),
            F.when(volume == 0, none).otherwise(_z(n, mu1, sd1)))


# -- match probability -------------------------------------------------------

def _word_root(word_p, wordlen) -> Column:
    """``word_p ** (1 / w)`` clipped to ``[0, 1]``."""
    return F.when(word_p > 0, F.least(F.lit(1.0), F.exp(F.ln(word_p) / F.lit(wordlen)))
                  ).otherwise(F.lit(0.0))


def match_probability(n, area, length, n_letters, wordlen) -> Column:
    """Match probability estimated from the seeds seen in a region."""
    mean, _ = null_constants(n_letters, wordlen)
    return _word_root((_c(n) - _c(area) * F.lit(mean)) / _c(length), wordlen)


def match_probability_multi(n, volume, length, n_letters, n_seqs, wordlen) -> Column:
    """N-sequence form: null exponent ``w (N - 1)``, root ``1 / w``."""
    n = _c(n)
    null = F.pow(F.lit(1.0 / n_letters), (F.lit(wordlen) * (_c(n_seqs) - 1)).cast("double"))
    return F.when(n > 0, _word_root((n - _c(volume) * null) / _c(length), wordlen)
                  ).otherwise(F.lit(0.0))


# -- closed forms used by the reports ----------------------------------------

def time_in_band(length: float, gap: float, radius: float) -> float:
    """Expected share of time an edit path of the given length and gap rate
    spends within a diagonal band; all arguments are driver-side."""
    x = radius / math.sqrt(2 * gap * length)
    inside = math.erf(x)
    edge = 2 / math.sqrt(math.pi) * math.exp(-x * x) - 2 * x * (1 - inside)
    return inside + x * edge


def erf(x) -> Column:
    """Error function, to about 1e-15: ``2 / sqrt(pi) * exp(-x^2)`` times the sum of ``2^n x^(2n+1) / (1 * 3 * ... * (2n+1))``,
    whose terms have one sign. Beyond 6 it is 1 in double precision."""
    x = _c(x).cast("double")
    near = F.least(F.abs(x), F.lit(6.0))
    start = F.struct(near.alias("term"), near.alias("total"), (2 * near * near).alias("twice"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(140)), start, lambda acc, n: F.struct(
        (acc["term"] * acc["twice"] / (2 * n + 1)).alias("term"),
        (acc["total"] + acc["term"] * acc["twice"] / (2 * n + 1)).alias("total"), acc["twice"].alias("twice")),
        lambda acc: acc["total"])
    return F.signum(x) * F.when(F.abs(x) >= 6, F.lit(1.0)).otherwise(
        F.lit(2 / math.sqrt(math.pi)) * F.exp(-near * near) * total)


def expected_time_in_band(length, gap, radius) -> Column:
    """``time_in_band`` of columns: the expected share of the steps of an edit path of a length and gap rate on diagonals
    within a radius. Null where nothing can leave the band's middle: no length or no gaps."""
    x = _c(radius) / F.sqrt(F.nullif(2.0 * _c(gap) * _c(length), F.lit(0.0)))
    inside = erf(x)
    return inside + x * (F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) - 2 * x * (1 - inside))


def neg_log_kmer_rank_prob(rank, wordlen) -> Column:
    """Rank-abundance model of words: ``w + p0 * rank + ln(rank) / 4`` with
    ``p0 = 4 ** -w``."""
    rank = _c(rank)
    return F.lit(wordlen) + F.lit(0.25 ** wordlen) * rank + F.ln(rank) / 4
