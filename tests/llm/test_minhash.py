"""The pipeline's near copies, by Jaccard similarity of five-word shingles, against brute force."""

import random

import corpus_pipeline
from kmerweave.llm import minhash, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_first(rows):
    """Rows that come first in their group, by comparing all pairs."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets, reach = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                reach[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((str(rows[k]) for k in range(len(rows)) if root(k) == k))


def edited(rnd, words, edits):
    words = list(words)
    for k in rnd.sample(range(len(words)), edits):
        words[k] = f"edit{rnd.randrange(10 ** 9)}"
    return " ".join(words)


def sample_rows():
    rnd, rows = random.Random(4), []
    for k in range(30):
        words = [f"w{rnd.randrange(3000)}" for _ in range(200)]
        rows += [(10 * k + j, edited(rnd, words, edits)) for j, edits in enumerate((0, 1, 2, 3, 4, 6, 12))]
    rows += [(1000, "a short text"), (1001, "A  short text"), (1002, ""), (1003, None), (1004, "a short one")]
    rows += [(None, rows[0][1]), (None, "nothing like it, and no id"), (5000, "one text of this id"), (5000, "and another")]
    return rows + [rows[7], rows[7]]


def test_stage_drops_copies_that_differ_in_a_few_words(spark, tmp_path, monkeypatch):
    rows = sample_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    wanted = plain_first(rows)
    for part in (minhash.PART, 300):
        monkeypatch.setattr(minhash, "PART", part)
        found = corpus_pipeline.deduplicate(spark, docs, "")
        assert found.columns == docs.columns
        # Texts without words are copies, whichever of them has the smallest id.
        assert sorted(str(tuple(r)) for r in found.collect()) == wanted


def test_odd_rows(odd_docs, odd_rows, no_docs):
    found = minhash.keep_first(odd_docs)
    assert found.columns == odd_docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in found.collect()) == plain_first([r[:2] for r in odd_rows])
    assert minhash.keep_first(no_docs).collect() == []


def test_texts_with_close_fingerprints_share_a_file(spark):
    chain = [0b1, 0b1111, 0b1111111, -1]
    rows = [(10 + k, 5, fp) for k, fp in enumerate(chain)] + [(20, 5, 0b1)]
    found = minhash.fingerprint_files(spark.createDataFrame(rows, "content bigint, n bigint, fp bigint")).collect()
    files = {}
    for r in found:
        files.setdefault(r.file, set()).add(r.content)
    assert sorted(map(sorted, files.values())) == [[10, 11, 12, 20], [13]]


def test_stage_drops_copies_that_fingerprints_link(spark):
    rnd = random.Random(6)
    refrain = "one two three four five " * 400
    tails = [" ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(30)) for _ in range(3)]
    rows = [(1, refrain + tails[0]), (2, refrain + tails[1]), (3, tails[2]), (4, tails[2] + " " + refrain)]
    assert len(shingles(rows[0][1]) & shingles(rows[1][1])) < 0.3 * len(shingles(rows[0][1]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    linked = simhash.near_duplicates(docs).where("doc_id = component_id").collect()
    assert sorted(r.doc_id for r in linked) == [1, 3]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 3]


def test_linked_odd_rows(spark, odd_docs, odd_rows, no_docs):
    found = minhash.keep_first_linked(odd_docs)
    assert found.columns == odd_docs.columns
    lowest = {}
    for doc_id, text in sorted({r[:2] for r in odd_rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        lowest.setdefault(simhash.fingerprint((text or "").encode()), (doc_id, text))
    # None of these texts is within three bits of another, but for equal fingerprints.
    assert {str((r.doc_id, r.text)) for r in found.collect()} == {str(r) for r in lowest.values()}
    assert minhash.keep_first_linked(no_docs).collect() == []
