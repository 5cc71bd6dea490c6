"""Phrases by sorted suffixes against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from kmerweave.llm import collocations


def plain(rows, longest, least, covered, top):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            counts[lang].update(" ".join(words[k:k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        for phrase, a in f.items():
            words = phrase.split(" ")
            if len(words) < 2 or a < least:
                continue
            around = [b for p, b in f.items() if b >= least and len(p) > len(phrase) and f" {phrase} " in f" {p} "]
            if any(100 * b >= covered * a for b in around):
                continue
            cuts = [(10 ** 6 * a * a // (f[" ".join(words[:k])] * f[" ".join(words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            kept.append((-score, -a, phrase.encode(), f[" ".join(words[:k])], f[" ".join(words[k:])]))
        out += [(lang, n + 1, p.decode(), -a, left, rest, sizes[lang], -s) for n, (s, a, p, left, rest) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def found(docs, **parameters):
    return sorted(map(tuple, collocations.collocations(docs, **parameters).collect()))


def sample_rows():
    rnd = random.Random(12)
    letters = "a b c d é ab b' ß $ \U0001f600".split(" ")
    rows = []
    for k in range(60):
        words = [rnd.choice(letters[:rnd.choice([2, 4, 10])]) for _ in range(rnd.choice([0, 1, 2, 30, 80]))]
        rows.append(("".join(w + rnd.choice([" ", " ", "  ", "\t", " \t ", ".", ", ", "\n", "? "]) for w in words),
                     rnd.choice(["a", "b", "en", None, "und"])))
    return rows + [("A B c. " * 40, "en"), ("a B C ! " * 40, "a"), (None, "a"), ("", None), (" \t ", "b")]


def test_phrases_match_brute_force(spark, monkeypatch):
    rows = sample_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for limits in ({}, {"ROWS_PER_TASK": 8, "POINTERS": 20, "TOGETHER": 200}, {"FILTER_BITS": 64}):
        for name, value in limits.items():
            monkeypatch.setattr(collocations, name, value)
        for longest, least, covered, top in ((3, 10, 50, 2000), (2, 1, 50, 20), (5, 4, 80, 2000)):
            assert found(docs, longest=longest, least=least, covered=covered, top=top) == plain(rows, longest, least, covered, top)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert found(odd_docs, lang_col="source", least=3) == plain([(r[1], r[2]) for r in odd_rows], 3, 3, 50, 2000)
    assert found(no_docs, lang_col="source") == []


def test_counts_beyond_64_bits(spark):
    """Scores of counts whose products pass 64 bits."""
    a, left, rest = 3_000_000_019, 900_000_000_000_077, 7_000_000_000_001
    counts = spark.createDataFrame([("x", "p q", a), ("x", "p", left), ("x", "q", rest)], "lang string, phrase string, f bigint")
    assert [r.score for r in collocations._scored(counts).collect()] == [10 ** 6 * a * a // (left * rest)]


def test_partitions_are_counts():
    rnd = np.random.default_rng(4)
    symbols = [rnd.integers(0, 3, 400) for _ in range(4)]
    for d in range(3):
        symbols[d + 1] = np.where((rnd.random(400) < 0.2) | (symbols[d] < 0), -1, symbols[d + 1])
    weights = rnd.integers(1, 4, 400)
    expected = Counter()
    for p in range(400):
        for d in range(1, 5):
            if symbols[d - 1][p] >= 0:
                expected[tuple(int(s[p]) for s in symbols[:d])] += int(weights[p])
    for least in (1, 6):
        got = {tuple(int(s[p]) for s in symbols[:depth]): int(n) for depth, at, sizes in collocations.partitions(
            symbols, weights, np.ones(400, bool), least, 1) for p, n in zip(at, sizes)}
        assert got == {k: n for k, n in expected.items() if n >= least}
