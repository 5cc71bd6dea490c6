"""SimHash near-duplicates and repeated passages against brute force."""

import hashlib
import random
import tracemalloc

import pyarrow as pa
import xxhash
from collections import Counter
from pyspark.sql import functions as F

from kmerweave.llm import simhash, substrings


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows):
    """Smallest id in reach, by comparing all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    reach = list(range(len(rows)))

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                reach[max(root(a), root(b))] = min(root(a), root(b))
    lowest = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[root(k)] = min(lowest.get(root(k), doc_id), doc_id)
    return [(doc_id, prints[k] - (1 << 64) * (prints[k] >> 63), lowest.get(root(k))) for k, (doc_id, _) in enumerate(rows)]


def test_near_duplicates_match_brute_force(spark, odd_docs, odd_rows, no_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    assert Counter(map(tuple, found)) == Counter(plain_components([r[:2] for r in odd_rows]))
    assert simhash.near_duplicates(no_docs).collect() == []


def test_links_inside_a_large_file(spark, monkeypatch):
    """Fingerprints that all share their blocks, compared part against part."""
    monkeypatch.setattr(simhash, "PART", 16)
    rnd = random.Random(5)
    prints = sorted({sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(150)})
    signed = [(p - (1 << 64) * (p >> 63),) for p in prints]
    edges = [(r.u, r.v) for r in simhash.links(spark.createDataFrame(signed, "fp bigint")).collect()]
    near = {(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    def components(pairs):
        reach = {p: p for (p,) in signed}
        def root(x):
            while reach[x] != x:
                x = reach[x]
            return x
        for a, b in pairs:
            reach[max(root(a), root(b))] = min(root(a), root(b))
        return {p: root(p) for p in reach}
    assert components(edges) == components(near)


def test_keep_first_keeps_columns_and_one_of_each_group(odd_docs, odd_rows, no_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    wanted = {d for d, _, c in plain_components([r[:2] for r in odd_rows]) if d is not None and d == c}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(wanted)
    assert ids.count(None) == sum(r[0] is None for r in odd_rows)
    assert simhash.keep_first(no_docs).collect() == []


def plain_repeats(rows):
    """Words kept of each row: windows in order of id (none last) and position; one document for equal ids."""
    key = lambda r: (1 << 63) - 1 if r[0] is None else r[0]
    first = {}
    for r in rows:
        words = (r[1] or "").encode().split()
        for s in range(len(words) - 19):
            w = tuple(words[s:s + 20])
            first[w] = min(first.get(w, (key(r), s)), (key(r), s))
    out = []
    for r in rows:
        words = (r[1] or "").encode().split()
        gone = set()
        for s in range(len(words) - 19):
            if first[tuple(words[s:s + 20])] != (key(r), s):
                gone.update(range(s, s + 20))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((r[0], len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def cut_rows(docs):
    cut = substrings.remove_repeats(docs)
    return [tuple(r) for r in cut.select("doc_id", "cut.n_words", "cut.n_removed", F.sha2("cut.kept", 256)).collect()]


def test_repeats_match_brute_force(spark, odd_docs, odd_rows, no_docs):
    assert Counter(cut_rows(odd_docs)) == Counter(plain_repeats([r[:2] for r in odd_rows]))
    assert cut_rows(no_docs) == []


def test_repeats_in_shuffled_passages_and_periodic_texts(spark):
    rnd = random.Random(3)
    parts = [" ".join(rnd.choice("abcdef") + str(rnd.randrange(9)) for _ in range(rnd.randint(5, 45))) for _ in range(12)]
    rows = [(n, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6)))) for n in range(60)]
    rows += [(60, "tick tock " * 40), (61, "tick " * 70), (62, "tick tock " * 15)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(cut_rows(docs)) == Counter(plain_repeats(rows))


def test_drop_repeats_leaves_other_texts_alone(odd_docs, odd_rows):
    out = substrings.drop_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == len(odd_rows)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] is None and texts[2] == "  \n\t " and texts[7] == ""


def test_paths_of_many_texts_take_little_memory():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(360)) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(1000)), "text": [t.encode() for t in texts]})
    list(substrings._paths([batch]))
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in substrings._paths([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 10_000 and peak < 48 << 20
