"""Spelling variants by composed acceptors against brute force."""

import random
import re
import zlib
from collections import Counter

from kmerweave.llm import spelling


def edit_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(rows, shortest, least, times, deleted):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % deleted == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: sorted((v for v in words if edit_apart(w, v)), key=lambda v: (-words[v], v)) for w in words}
    forms = {w: v[0] for w, v in near.items() if v and words[v[0]] >= times * words[w]}

    def root(w):
        return root(forms[w]) if w in forms else w

    return sorted((w, forms.get(w) or "", root(w), n, len(near[w]), words[forms[w]] if w in forms else -1) for w, n in words.items())


def found(docs, **parameters):
    rows = spelling.variants(docs, **parameters).collect()
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in rows)


def sample_rows():
    rnd = random.Random(6)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.choice([4, 6, 7, 8, 9, 12]))) for _ in range(60)]
    rows = []
    for k in range(80):
        words = []
        for _ in range(150):
            word = stems[int(len(stems) * rnd.random() ** 3)]
            if rnd.random() < 0.3:
                at = rnd.randrange(len(word) + 1)
                word = word[:at] + rnd.choice(["", "a", "b", "É", "÷"]) + word[at + rnd.randrange(2):]
            words.append(word.title() if rnd.random() < 0.1 else word)
        rows.append((k if k % 7 else None, " ".join(w + rnd.choice(["", ",", "7", "-"]) for w in words)))
    return rows + [(1, None), (None, ""), (2, "aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa aaaaaaa aaaaaaa " * 3)]


def test_words_match_brute_force(spark, monkeypatch):
    rows = sample_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for limits in ({}, {"PART": 9, "HELD": 5}):
        for name, value in limits.items():
            monkeypatch.setattr(spelling, name, value)
        for shortest, least, times, deleted in ((7, 2, 10, 31), (2, 1, 2, 3), (3, 2, 3, 1)):
            parameters = {"shortest": shortest, "least": least, "times": times, "deleted": deleted}
            assert found(docs, **parameters) == plain(rows, **parameters)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    parameters = {"shortest": 3, "least": 1, "times": 2, "deleted": 31}
    assert found(odd_docs, **parameters) == plain([r[:2] for r in odd_rows], **parameters)
    assert found(no_docs) == []


def test_very_long_words_and_long_chains_of_forms(spark):
    long = "xy" * 20_000
    rows = [(1, f"{long} {long} {long[:-1]}z {long[:-1]}z {long[1:]} {long[1:]}")]
    chain = ["abcdefghij" + "k" * n for n in range(5)]
    rows += [(2 + n, " ".join([w] * 3 ** n)) for n, w in enumerate(chain)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    result = {r.word: r for r in spelling.variants(docs, least=1, times=3, deleted=1 << 40).collect()}
    assert (result[long].n_near, result[long[1:]].n_near, result[long[:-1] + "z"].n_near) == (2, 1, 1)
    assert [result[w].form for w in chain] == chain[1:] + [None] and {result[w].root for w in chain} == {chain[-1]}


def test_acceptors_are_minimal():
    words = sorted(a + b for a in ("ab", "cd", "ce") for b in ("xyz", "xy", "w"))
    acceptors = spelling.Acceptors()
    root = acceptors.add(words)
    rests = [set(acceptors.common(k, k)) for k in range(len(acceptors.arcs))]
    assert rests[root] == set(words)
    assert len({frozenset(r) for r in rests}) == len(rests)  # no two states accept the same rests
