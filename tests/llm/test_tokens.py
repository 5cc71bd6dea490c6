"""Token files, byte-level BPE and language-model scores against plain versions."""

import math
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kmerweave.llm import byte_bpe, distinct, gru, lm_score, token_files
from kmerweave.llm.common import bucket_of

TRICKY = ["", " ", "a", " a", "a ", "  a  b", "a\n b", "it's  'tis 's", "x" * 300, "é è\u00a0 \u3000 ü b", "a\t b \n\n c",
          "1 22,333. 4", "🙂 🙂🙂", "<|endoftext|> a", "don't!? ...", "a\u2003 b\u2003b", "\x1c \x1f a", "a.b,c d,", "ſ K ñ, ß."]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def small_chunks(monkeypatch_module):
    for reader in (distinct.Words, byte_bpe.Segments, byte_bpe.PreTokens):
        monkeypatch_module.setattr(reader, "chunk_bytes", 2000)
    monkeypatch_module.setattr(distinct, "ROW_WORDS", 100)


@pytest.fixture(scope="module")
def monkeypatch_module():
    with pytest.MonkeyPatch.context() as patch:
        yield patch


def test_pack_round_trip():
    values = np.array([0, 1, 255, 256, 70_000, 2 ** 32 - 1])
    assert distinct.unpack(distinct.pack(values)).tolist() == values.tolist()
    assert distinct.unpack(distinct.pack(np.zeros(0, int))).tolist() == []
    words = [b"", b"a", b"\n", "é".encode()]
    assert distinct.unpack_bytes(*distinct.pack_bytes(words)) == words


def test_segments_and_parts_give_the_patterns_matches():
    reader = byte_bpe.PreTokens(public_tokenizers.PATTERN)
    for text in TRICKY:
        data, starts, ends, first = reader.spans([text.encode()])
        parts = [p for a, b in zip(starts, ends) for p in (reader.parts(data[a:b]) or [data[a:b]])]
        assert [p.decode() for p in parts] == regex.findall(public_tokenizers.PATTERN, text), text
        assert first.tolist() == [0, len(starts)]


def test_white_space_outside_ascii_is_found():
    spaces = [chr(c) for c in range(128, 0x3100) if chr(c).isspace()]
    found = [chr(c) for c in range(128, 0x3100) if byte_bpe._has_wide_space(f"é\u2019{chr(c)}a".encode())]
    assert found == spaces


def test_words_of_chunks_are_cut_from_the_bytes():
    class Rows:
        def mapInArrow(self, rows, schema):
            return rows

    texts = [TRICKY[n % len(TRICKY)].encode() * 3 for n in range(60)]
    for reader in (distinct.Words(), byte_bpe.Segments()):
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": texts})
        found = []
        for row in distinct.word_rows(Rows(), reader, 7)(iter([batch])):
            r = row.to_pylist()[0]
            found += zip(distinct.unpack_bytes(r["lengths"], r["words"]), distinct.unpack(r["counts"]).tolist())
        data, starts, ends, _ = reader.spans(texts)
        assert dict(found) == Counter(data[a:b] for a, b in zip(starts, ends)) and len(found) == len(dict(found))


def test_ids_match_the_library_and_decode(spark, odd_docs, odd_rows, no_docs, ranks, small_chunks):
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(odd_docs, ranks, public_tokenizers.PATTERN)
    found = byte_bpe.decode(encoded, ranks).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.bytes)) for r in found) == Counter(
        (r[0], tuple(plain.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in odd_rows)
    assert byte_bpe.encode(no_docs, ranks, public_tokenizers.PATTERN).collect() == []


def test_ids_of_tricky_texts(spark, ranks, tmp_path):
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spark.createDataFrame(list(enumerate(TRICKY)), "doc_id bigint, text string").write.parquet(str(tmp_path / "t"))
    found = byte_bpe.encode(spark.read.parquet(str(tmp_path / "t")), ranks, public_tokenizers.PATTERN, form="bytes")
    for r in found.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(TRICKY[r.doc_id]), TRICKY[r.doc_id]


def test_another_order_on_the_second_read_fails(spark, odd_docs, ranks):
    shuffled = F.udf(lambda text: f"{text} {uuid.uuid4()}").asNondeterministic()
    encoded = byte_bpe.encode(odd_docs.withColumn("text", shuffled("text")), ranks, public_tokenizers.PATTERN)
    with pytest.raises(Exception, match="another order"):
        encoded.collect()


@pytest.fixture(scope="module")
def tokenizer_json():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as file:
        return file.read()


def test_token_files_round_trip(spark, odd_docs, odd_rows, no_docs, tokenizer_json, tmp_path, monkeypatch):
    plain = Tokenizer.from_str(tokenizer_json)
    plain.encode_special_tokens = True
    read = token_files.round_trip(odd_docs, tokenizer_json, str(tmp_path / "files")).collect()
    tokens = {}
    for r in odd_rows:
        tokens.setdefault(r[0], []).append(tuple(plain.encode(r[1] or "", add_special_tokens=False).ids + [0]))
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in read)
    assert got == Counter((d, t) for d, many in tokens.items() for t in many)
    at = 0
    for r in sorted(read, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids) // 4
    ids = [r.doc_id for r in sorted(read, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    assert token_files.round_trip(no_docs, tokenizer_json, str(tmp_path / "none")).collect() == []
    for path in (tmp_path / "files").iterdir():
        reader = pa.ipc.open_file(pa.memory_map(str(path)))
        before = pa.total_allocated_bytes()
        rows = reader.get_batch(0)
        assert pa.total_allocated_bytes() == before  # a view of the file
        assert rows.schema.field("ids").type == pa.list_(pa.uint16(), token_files.LENGTH)
        assert rows.schema.field("mask").type == pa.list_(pa.bool_(), token_files.LENGTH)


def test_ids_between_the_jobs_take_less_than_document_by_document(spark, tmp_path, monkeypatch):
    random = np.random.default_rng(3)
    passages = [random.zipf(1.2, 60) % 50_000 for _ in range(40)]
    documents = [np.concatenate([passages[k] for k in random.integers(0, 40, 4)]) for _ in range(500)]
    rows = [(n, distinct.pack(x), n // 250) for n, x in enumerate(documents)]
    encoded = spark.createDataFrame(rows, "doc_id bigint, ids binary, part int").repartition(3)
    stored, cut = {}, token_files.cut_lineage

    def kept(df, label):
        stored[label] = cut(df, label)
        return stored[label]

    monkeypatch.setattr(token_files, "cut_lineage", kept)
    folder = str(tmp_path / "files")
    read = token_files.documents(token_files.write(encoded, folder, 50_000), folder).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in read} == {
        n: [*x.tolist(), token_files.END] for n, x in enumerate(documents)}
    size = sum(len(v) for row in stored["token-ids"].collect() for v in row if isinstance(v, (bytes, bytearray)))
    assert size < 0.8 * sum(len(ids) for _, ids, _ in rows)


def test_a_wide_vocabulary_takes_32_bits():
    assert token_files.schema(70_000).field("ids").type.value_type == pa.uint32()


def test_counts_and_base_scores(odd_docs, odd_rows, no_docs, small_chunks):
    held = bucket_of("doc_id", 7) == 2
    found = lm_score.scores(odd_docs, held).collect()
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in odd_rows]
    is_held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(t for d, ts in tokens if not is_held(d) for t in ts)
    n, v = sum(counts.values()), len(counts)
    base = lambda ts: sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == Counter(
        (d, len(ts), sum(counts[t] > 0 for t in ts), n, round(base(ts), 6)) for d, ts in tokens)
    assert all(r.score < 0 for r in found)
    assert lm_score.scores(no_docs, held).collect() == []
    unlearned = lm_score.scores(odd_docs, F.lit(True)).collect()
    assert all(r.train_tokens == r.n_known == 0 and r.score < 0 for r in unlearned)


def test_gradients_match_differences():
    random = np.random.default_rng(0)
    params = {k: x + random.normal(0, 0.1, x.shape) for k, x in gru.start(1 / np.arange(1.0, 61), hidden=8).items()}
    inputs, targets = random.integers(0, 60, (5, 3)), random.integers(0, 60, (5, 3))
    valid, state = random.random((5, 3)) < 0.8, random.normal(0, 1, (3, 8))

    def loss(p):
        states, _ = gru._states(p, inputs, state)
        return -gru.log_probabilities(p, states[valid].astype(float), targets[valid]).mean()

    found, _ = gru._gradients(params, inputs, targets, valid, state)
    for name in params:
        at = np.unravel_index(np.abs(found[name]).argmax(), found[name].shape)
        up, down = ({k: x.copy() for k, x in params.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert (loss(up) - loss(down)) / 2e-3 == pytest.approx(found[name][at], rel=2e-2, abs=1e-5)


def test_probabilities_sum_to_one_and_training_helps():
    random = np.random.default_rng(0)
    documents = [np.resize([1, 2, 3, 4, 5, 6], int(n)) for n in random.integers(20, 400, 60)]
    start = gru.start(np.ones(70))
    states = random.normal(0, 1, (3, gru.HIDDEN)).astype(np.float32)
    total = sum(np.exp(gru.log_probabilities(start, states, np.full(3, s))) for s in range(70))
    assert total == pytest.approx(np.ones(3), abs=1e-4)
    trainer = gru.Trainer(start, 0.02)
    for epoch in range(8):
        trainer.learn([p for d in documents for p in gru.pieces_of(d, 0, 1, 0)], epoch)
    before, after = (gru.score(p, documents, 0).sum() / sum(map(len, documents)) for p in (start, trainer.p))
    assert after > before + 2


def test_state_is_carried_and_batches_do_not_matter():
    random = np.random.default_rng(2)
    params = {k: (x + random.normal(0, 0.3, x.shape)).astype(np.float32) for k, x in gru.start(np.ones(64)).items()}
    documents = [random.integers(0, 64, n) for n in (1, 31, 32, 33, 100, 257, 5)]
    alone = np.array([gru.score(params, [d], 3)[0] for d in documents])
    assert gru.score(params, documents, 3, together=3) == pytest.approx(alone, rel=1e-4)
    state, whole, last = np.zeros((1, gru.HIDDEN), np.float32), 0.0, 3
    for symbol in documents[5]:
        states, _ = gru._states(params, np.array([[last]]), state)
        whole, state, last = whole + gru.log_probabilities(params, states[0], np.array([symbol]))[0], states[0], symbol
    assert alone[5] == pytest.approx(whole, rel=1e-4)
    assert gru.score(params, [], 3).tolist() == []


def test_segments_are_encoded_together_and_kept_apart():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    numbers = " ".join(f"w{k}, {k}é" for k in range(2000))
    whole, starts, ends, _ = byte_bpe.Segments().spans([t.encode() for t in [*TRICKY, numbers]])
    segments = list(dict.fromkeys(whole[a:b] for a, b in zip(starts, ends)))
    asked = []

    class Counting:
        get_vocab = tokenizer.get_vocab

        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    found = list(token_files.encoder_of(Counting())(segments))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [
        tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in segments]
    apart = [w for w in segments if not (w[:1] == b" " and 32 < w[-1] < 127)]
    assert len(asked) <= len(apart) + len(segments) / token_files.TOGETHER + 1
