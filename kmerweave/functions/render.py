"""Terminal rendering of alignments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

# ANSI sequences for matches, substitutions and reset.
COLOURS = {"M": "\x1b[32m", "S": "\x1b[31m"}
RESET = "\x1b[0m"


def _layout(origin, mutant, tx, i, j, n, width, margin, colored):
    """Two-line text of one alignment given as lists of letters."""
    ahead = min(margin, max(i, j) * n)
    columns, oi, mi = [], i - ahead, j - ahead
    behind_o, behind_m = i + sum(op != "I" for op in tx), j + sum(op != "D" for op in tx)
    after = min(margin, max(len(origin) - behind_o, len(mutant) - behind_m) * n)
    for op in [None] * ahead + list(tx) + [None] * after:
        filler = ("." if op is None else "-") * n
        shown_o = 0 <= oi < len(origin) and op != "I"
        shown_m = 0 <= mi < len(mutant) and op != "D"
        columns.append((op, oi, mi, origin[oi] if shown_o else filler, mutant[mi] if shown_m else filler))
        oi, mi = oi + (op != "I"), mi + (op != "D")
    blocks, top, low, used = [], "", "", width
    for op, oi, mi, o, m in columns:
        if used >= width:
            if top:
                blocks.append((top, low))
            heads = f"origin[{oi}]: ", f"mutant[{mi}]: "
            size = max(map(len, heads))
            top, low, used = heads[0].rjust(size), heads[1].rjust(size), size
        if colored and op in COLOURS:
            o, m = COLOURS[op] + o + RESET, COLOURS[op] + m + RESET
        top, low, used = top + o, low + m, used + n
    blocks.append((top, low))
    return "".join(f"{a}\n{b}\n" for a, b in blocks)


def render(origin, mutant, tx, origin_start, mutant_start, letter_len=1, width=120, margin=0,
           colored=True) -> Column:
    """Two-line rendering, wrapped at ``width`` characters, with up to ``margin``
    letters of context on both sides."""
    if width < 30 or margin < 0:
        raise ValueError("the width must be at least 30 and the margin not negative")

    @F.pandas_udf("string")
    def run(o: pd.Series, m: pd.Series, t: pd.Series, i: pd.Series, j: pd.Series) -> pd.Series:
        def cut(s):
            return [s[k:k + letter_len] for k in range(0, len(s), letter_len)]
        return pd.Series([
            None if row[2] is None else _layout(cut(row[0]), cut(row[1]), row[2], int(row[3]), int(row[4]),
                                                letter_len, width, margin, colored)
            for row in zip(o, m, t, i, j)], dtype=object)

    return run(origin, mutant, tx, origin_start, mutant_start)
