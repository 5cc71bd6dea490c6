"""Pairwise alignment of candidate pairs by dynamic programming.

Spark supplies and balances the pairs; an Arrow-batched function aligns them,
many pairs at a time: cells of one antidiagonal, for all pairs of a group of
similar size, are one numpy operation.

A cell keeps every tied best operation. Operations are ordered begin, delete,
insert, match/substitute, the first tied one stands for the cell, and a gap looks
for its own kind among the tied operations it extends, so that affine gaps are
opened relative to optimal predecessors only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kmerweave.functions.alphabet import DIGITS, Alphabet

# Alignment types by mode.
STANDARD_TYPES = ("GLOBAL", "LOCAL", "START_ANCHORED", "END_ANCHORED", "OVERLAP",
                  "START_ANCHORED_OVERLAP", "END_ANCHORED_OVERLAP")
BANDED_TYPES = ("B_GLOBAL", "B_OVERLAP", "B_LOCAL")

BEGIN, DELETE, INSERT, PAIR = range(4)
# Cells of the tables that leave Python together, and padded cells per group of pairs, one traceback byte each.
TABLE_CELLS = 1 << 20
GROUP_CELLS = 1 << 23
NONE = -np.inf
RESULT = "score double, transcript string, origin_start int, mutant_start int"


def _check(kind, diag_range):
    if kind not in STANDARD_TYPES + BANDED_TYPES:
        raise ValueError(f"unknown alignment type: {kind}")
    if (kind in BANDED_TYPES) != (diag_range is not None):
        raise ValueError("a diagonal range goes with the banded types and only with them")


def score_matrix(n_letters, match=1.0, mismatch=0.0):
    return [[float(match if i == j else mismatch) for j in range(n_letters)] for i in range(n_letters)]


# Lowest set bit of every tie mask.
FIRST = np.array([PAIR] + [(ties & -ties).bit_length() - 1 for ties in range(1, 16)], np.uint8)


def gap_rules(go):
    """For deletions and insertions and every set of tied operations: what a gap behind it costs beyond its extension, and
    which of the tied operations it extends (the first one where several are equally good)."""
    added, extended = {}, {}
    for own in (DELETE, INSERT):
        added[own], extended[own] = np.full(16, NONE), np.zeros(16, np.uint8)
        for ties in range(1, 16):
            others = ties & ~(1 << own)
            keep = ties >> own & 1 and (not others or go < 0 or (go == 0 and FIRST[ties] == own))
            added[own][ties] = 0.0 if keep else float(go)
            extended[own][ties] = own if keep else FIRST[others]
    return added, extended


def _frames(n, m, bands):
    """The part of each table that its band passes: ``(n, m, lo, hi, start)``. In front of the first and behind the last
    cell of a band is nothing to fill."""
    if bands is None:
        return n, m, -m, n, np.zeros((2, len(n)), np.int64)
    lo, hi = bands[:, 0].astype(np.int64), bands[:, 1].astype(np.int64)
    by_x, by_y = np.maximum(lo, 0), np.maximum(-hi, 0)
    n, m = np.minimum(n, m + hi) - by_x, np.minimum(m, n - lo) - by_y
    return n, m, np.maximum(lo - by_x + by_y, -m), np.minimum(hi - by_x + by_y, n), np.stack([by_x, by_y])


class _Group:
    """Alignment of pairs padded to common dimensions.

    Arrays have a row for each ``x`` of an antidiagonal and a column for each pair, so neighbours are slices. What lies
    beyond a pair's own table is filled, too, unless it could end there: no path leads back from it into the table. The
    cells in reach of a band alone are walked. Only tied operations are kept; what a gap extends follows from them.
    """

    def __init__(self, origins, mutants, kind, subst, go, ge, bands, keep_scores=False):
        self.kind, self.origins, self.mutants = kind, origins, mutants
        rows = len(origins)
        n, m, lo, hi, self.shift = _frames(*(np.array([len(x) for x in seqs], np.int64) for seqs in (origins, mutants)), bands)
        by_x, by_y = self.shift
        wide, tall = int(n.max()), int(m.max())
        # Letters in front of x (row x) and, in reverse, in front of y.
        pad_o, pad_m = np.zeros((wide + 1, rows), np.uint8), np.zeros((tall + 1, rows), np.uint8)
        for r in range(rows):
            pad_o[1:n[r] + 1, r] = origins[r][by_x[r]:by_x[r] + n[r]]
            pad_m[tall - m[r]:tall, r] = mutants[r][by_y[r]:by_y[r] + m[r]][::-1]
        subst = np.asarray(subst, float)
        off = subst[~np.eye(len(subst), dtype=bool)]
        plain = len(set(np.diag(subst))) == 1 and len(set(off)) <= 1
        match, mismatch = float(subst[0, 0]), float(off[0]) if len(off) else 0.0
        added, self.extended = gap_rules(go)
        free = kind in ("LOCAL", "END_ANCHORED", "B_LOCAL")
        edge = kind in ("OVERLAP", "END_ANCHORED_OVERLAP", "B_OVERLAP")
        anywhere = kind in ("LOCAL", "START_ANCHORED", "B_LOCAL")
        at_edges = kind in ("OVERLAP", "START_ANCHORED_OVERLAP", "B_OVERLAP")
        lowest, highest = int(lo.min()), int(hi.max())
        # Pairs whose band is not the group's, or whose table is smaller where any cell may be an end.
        narrow_lo, narrow_hi = int(np.where(lo > -m, lo, lowest).max()), int(np.where(hi < n, hi, highest).min())
        least_n, least_m = int(n.min()), int(m.min())
        trim = (anywhere or keep_scores) and (least_n < wide or least_m < tall)
        self.tables = [np.full((x, y), NONE) for x, y in zip(n, m)] if keep_scores else None
        # LOCAL and START_ANCHORED must beat the empty alignment at the origin.
        self.best = np.full(rows, 0.0 if kind in ("LOCAL", "START_ANCHORED") else NONE)
        self.best_key = np.full(rows, -1, np.int64)
        self.end = np.full((rows, 2), -1, np.int64)
        total, each = n + m, np.arange(rows)
        last = int(total.max())
        self.x_from, self.ties = [0] * (last + 1), [None] * (last + 1)
        # Row x + 1 of a buffer belongs to x: scores, and scores behind a deletion and an insertion.
        scores = [np.full((wide + 3, rows), NONE) for _ in range(3)]
        deleted, inserted = ([np.full((wide + 3, rows), NONE) for _ in range(2)] for _ in range(2))
        widest = min(wide, tall, (highest - lowest) // 2 + 1) + 2
        room, marks = np.empty((widest, rows)), np.empty((widest, rows), bool)
        for t in range(last + 1):
            x_from = max(0, t - tall, -((-t - lowest) // 2))
            x_to = min(wide, t, (t + highest) // 2)
            new, older = scores[t % 3], scores[(t - 2) % 3]
            new_d, new_i, old_d, old_i = deleted[t % 2], inserted[t % 2], deleted[t % 2 - 1], inserted[t % 2 - 1]
            if x_from > x_to:
                for buffer in (new, new_d, new_i):
                    buffer[max(0, min(x_from, x_to)):x_from + 3] = NONE
                continue
            cells, before = slice(x_from + 1, x_to + 2), slice(x_from, x_to + 1)
            size = x_to - x_from + 1
            score, paired, flag = new[cells], room[:size], marks[:size]
            by_d, by_i = old_d[before], old_i[cells]
            # y - 1 = t - x - 1 for each x, in the reversed mutants.
            y_at = tall - t + x_from
            letters_o = pad_o[x_from:x_to + 1]
            letters_m = pad_m[y_at:y_at + size]
            if plain:
                np.equal(letters_o, letters_m, out=flag)
                np.add(older[before], np.where(flag, match, mismatch), out=paired)
            else:
                np.add(older[before], subst[letters_o, letters_m], out=paired)
            np.maximum(by_d, by_i, out=score)
            np.maximum(score, paired, out=score)
            ties = np.zeros((size, rows), np.uint8)
            if free:
                np.maximum(score, 0.0, out=score)
                np.equal(score, 0.0, out=flag)
                ties |= flag.view(np.uint8)
            else:
                for at in {x for x in (0, t) if x_from <= x <= x_to} if edge or t == 0 else ():
                    np.maximum(score[at - x_from], 0.0, out=score[at - x_from])
                    ties[at - x_from] |= score[at - x_from] == 0.0
            for bit, found in ((PAIR, paired), (INSERT, by_i), (DELETE, by_d)):
                np.equal(found, score, out=flag)
                ties |= flag.view(np.uint8) << bit
            if narrow_lo > lowest:
                some = np.arange(x_from, min(x_to, (t + narrow_lo - 1) // 2) + 1)
                score[:len(some)][2 * some[:, None] - t < lo] = NONE
            if narrow_hi < highest:
                some = np.arange(max(x_from, (t + narrow_hi) // 2 + 1), x_to + 1)
                score[size - len(some):][2 * some[:, None] - t > hi] = NONE
            if trim:
                some = np.arange(max(x_from, least_n + 1), x_to + 1)
                score[size - len(some):][some[:, None] > n] = NONE
                some = np.arange(x_from, min(x_to, t - least_m - 1) + 1)
                score[:len(some)][t - some[:, None] > m] = NONE
            self.x_from[t], self.ties[t] = x_from, ties
            if anywhere:
                top = score.max(axis=0)
                some = np.flatnonzero((top > NONE) & ((top > self.best) | ((top == self.best) & (self.end[:, 0] >= 0))))
                if len(some):
                    x = x_from + score[:, some].argmax(axis=0)
                    self._note(some, x, t - x, top[some])
            elif at_edges:
                for x in (t - m, n):
                    some = each[(x >= np.maximum(0, t - m)) & (x <= np.minimum(n, t)) & (x >= x_from) & (x <= x_to)]
                    if len(some):
                        self._note(some, x[some], t - x[some], new[x[some] + 1, some])
            else:
                some = np.flatnonzero((total == t) & (n >= x_from) & (n <= x_to))
                if len(some):
                    self._note(some, n[some], m[some], new[n[some] + 1, some])
            if keep_scores:
                for r, table in enumerate(self.tables):
                    x = np.arange(max(x_from, t - int(m[r]) + 1), min(x_to, int(n[r]) - 1) + 1)
                    table[x, t - x] = score[x - x_from, r]
            np.add(score, ge, out=new_d[cells])
            new_i[cells] = new_d[cells]
            if go < 0:
                for own, buffer in ((DELETE, new_d), (INSERT, new_i)):
                    np.equal(ties & np.uint8(1 << own), 0, out=flag)
                    buffer[cells] += np.multiply(flag, go, out=paired)
            elif go > 0:
                new_d[cells] += added[DELETE][ties]
                new_i[cells] += added[INSERT][ties]
            for buffer in (new, new_d, new_i):
                buffer[x_from] = buffer[x_to + 2] = NONE

    def _note(self, pairs, x, y, score):
        """Remembers the best end so far; among equals the first one in order of
        rows, or of diagonals when banded."""
        if self.kind in BANDED_TYPES:
            key = (x - y) * (1 << 31) + np.minimum(x, y)
        else:
            key = x * (1 << 31) + y
        best, found = self.best[pairs], self.end[pairs, 0] >= 0
        better = (score > best) | ((score == best) & (score > NONE) & found & (key < self.best_key[pairs]))
        pairs = pairs[better]
        self.best[pairs], self.best_key[pairs] = score[better], key[better]
        self.end[pairs, 0], self.end[pairs, 1] = x[better], y[better]

    def result(self, r, min_score):
        """``(score, transcript, origin start, mutant start)`` of one pair."""
        x, y = map(int, self.end[r])
        if x < 0 or self.best[r] < min_score:
            return None, None, None, None
        by_x, by_y = map(int, self.shift[:, r])
        ops, origin, mutant = [], self.origins[r][by_x:].tolist(), self.mutants[r][by_y:].tolist()
        first, by_d, by_i = FIRST.tolist(), *(self.extended[own].tolist() for own in (DELETE, INSERT))
        x_from, ties = self.x_from, self.ties
        op = first[ties[x + y][x - x_from[x + y], r]]
        while op != BEGIN:
            if op == PAIR:
                x, y = x - 1, y - 1
                ops.append("M" if origin[x] == mutant[y] else "S")
                op = first[ties[x + y][x - x_from[x + y], r]]
            elif op == DELETE:
                ops.append("D")
                x -= 1
                op = by_d[ties[x + y][x - x_from[x + y], r]]
            else:
                ops.append("I")
                y -= 1
                op = by_i[ties[x + y][x - x_from[x + y], r]]
        if not ops:
            return float(self.best[r]), None, None, None
        return float(self.best[r]), "".join(reversed(ops)), x + by_x, y + by_y


_CODE = np.zeros(256, np.uint8)
for _i, _d in enumerate(DIGITS):
    _CODE[ord(_d)] = _i


def _codes(digits):
    return _CODE[np.frombuffer(digits.encode("ascii"), np.uint8)]


def _groups(sizes, bands):
    """Index groups of similar pairs whose padded tables stay within bounds: parts inside the band, if there is one."""
    n, m, lo, hi, _ = _frames(*np.array(sizes, np.int64).reshape(-1, 2).T, bands)
    cells = _cells(n, m, lo, hi)
    order = np.lexsort((np.minimum(n, m), np.maximum(n, m), np.frexp(hi - lo + 1)[1]))
    group, frame, own = [], None, 0
    for r, x, y, low, high, c in zip(*(v[order].tolist() for v in (np.arange(len(n)), n, m, lo, hi, cells))):
        wider = (x, y, low, high) if frame is None else (
            max(frame[0], x), max(frame[1], y), min(frame[2], low), max(frame[3], high))
        padded, own = int(_cells(*wider)) * (len(group) + 1), own + c
        if group and (padded > GROUP_CELLS or padded > GROUP_CELLS // 8 and padded > 1.5 * own):
            yield group
            group, wider, own = [], (x, y, low, high), c
        group.append(r)
        frame = wider
    if group:
        yield group


def _cells(n, m, lo, hi):
    return (n + m + 1) * (np.minimum(np.minimum(n, m), (hi - lo) // 2) + 1)


def align(origin, mutant, alphabet: Alphabet, kind="GLOBAL", *, subst_scores=None, match=1.0,
          mismatch=0.0, go_score=0.0, ge_score=0.0, diag_range=None, min_score=float("-inf"),
          origin_range=None, mutant_range=None) -> Column:
    """Struct column ``(score, transcript, origin_start, mutant_start)`` with one
    optimal alignment of two sequence columns.

    ``kind`` is one of the standard or banded types. Banded types take
    ``diag_range``, a pair of numbers or columns, which must lie within the table.
    Ranges, also pairs of numbers or columns, restrict the alignment to parts of
    the sequences. All NULL where no alignment exists or it scores below
    ``min_score``; the transcript alone is NULL where the optimum is empty.
    """
    _check(kind, diag_range)
    subst = subst_scores or score_matrix(len(alphabet), match, mismatch)
    if len(subst) != len(alphabet):
        raise ValueError("one row of substitution scores per letter is needed")

    @F.pandas_udf(RESULT)
    def run(o: pd.Series, t: pd.Series, lo: pd.Series, hi: pd.Series,
            o_at: pd.Series, t_at: pd.Series) -> pd.DataFrame:
        origins, mutants = [_codes(s) for s in o], [_codes(s) for s in t]
        sizes = [(len(a), len(b)) for a, b in zip(origins, mutants)]
        bands = None
        if kind in BANDED_TYPES:
            bands = np.stack([lo.to_numpy(np.int64), hi.to_numpy(np.int64)], axis=1)
            for (n, m), (d0, d1) in zip(sizes, bands):
                if not -m <= d0 <= d1 <= n:
                    raise ValueError(f"band ({d0}, {d1}) exceeds a {n} x {m} table")
                if kind == "B_GLOBAL" and not (d0 <= n - m <= d1 and d0 <= 0 <= d1):
                    raise ValueError(f"band ({d0}, {d1}) misses an end of a {n} x {m} table")
        out = [None] * len(sizes)
        for group in _groups(sizes, bands):
            dp = _Group([origins[r] for r in group], [mutants[r] for r in group], kind, subst,
                        go_score, ge_score, bands[group] if bands is not None else None)
            for k, r in enumerate(group):
                score, tx, x, y = dp.result(k, min_score)
                out[r] = (score, tx, None if x is None else x + int(o_at[r]),
                          None if y is None else y + int(t_at[r]))
        frame = pd.DataFrame(out, columns=["score", "transcript", "origin_start", "mutant_start"])
        return frame.astype({"origin_start": "Int32", "mutant_start": "Int32"})

    def part(seq, bounds):
        if bounds is None:
            return alphabet.digits(seq), F.lit(0)
        return alphabet.digits(alphabet.slice(seq, *map(_num, bounds))), _num(bounds[0])

    o, o_at = part(origin, origin_range)
    t, t_at = part(mutant, mutant_range)
    lo, hi = diag_range if diag_range is not None else (0, 0)
    return run(o, t, _num(lo), _num(hi), o_at, t_at)


def table_scores(origin, mutant, alphabet: Alphabet, kind="GLOBAL", *, subst_scores=None, match=1.0,
                 mismatch=0.0, go_score=0.0, ge_score=0.0) -> Column:
    """``array<array<double>>`` of cell scores, one row per origin position and one
    column per mutant position (the last row and column of the table left out);
    standard types only. NULL marks cells no alignment reaches."""
    if kind not in STANDARD_TYPES:
        raise ValueError("table scores exist for the standard types only")
    subst = subst_scores or score_matrix(len(alphabet), match, mismatch)

    @F.arrow_udf("array<array<double>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            origins, mutants = ([_codes(s) for s in side.to_pylist()] for side in batch)
            sizes = [(len(a), len(b)) for a, b in zip(origins, mutants)]
            ends = np.cumsum([n * m for n, m in sizes]) // TABLE_CELLS
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(ends)) + 1) if sizes else []:
                tables = [None] * len(part)
                for group in _groups([sizes[r] for r in part], None):
                    pairs = [part[k] for k in group]
                    dp = _Group([origins[r] for r in pairs], [mutants[r] for r in pairs], kind, subst, go_score, ge_score,
                                None, keep_scores=True)
                    for k, table in zip(group, dp.tables):
                        tables[k] = table
                yield _nested(tables)

    return run(alphabet.digits(origin), alphabet.digits(mutant))


def _nested(tables):
    """Tables as one Arrow array of arrays of rows, NULL where a score is missing."""
    values = np.concatenate([t.ravel() for t in tables])
    widths = np.concatenate([np.full(*t.shape) for t in tables])
    rows, cells = (np.concatenate([[0], np.cumsum(x)]).astype(np.int32) for x in ([len(t) for t in tables], widths))
    return pa.ListArray.from_arrays(rows, pa.ListArray.from_arrays(cells, pa.array(values, mask=values == NONE)))


def align_pairs(pairs: DataFrame, origin="origin", mutant="mutant", *, alphabet, **kw) -> DataFrame:
    """Aligns every row of a table of pairs, spread evenly over the tasks first:
    alignment costs far more than moving two sequences."""
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    out = pairs.repartition(4 * cores).withColumn("aln", align(origin, mutant, alphabet, **kw))
    return out.select(*pairs.columns, "aln.*")


def _num(x):
    if isinstance(x, Column):
        return x.cast("int")
    return F.col(x).cast("int") if isinstance(x, str) else F.lit(int(x))
