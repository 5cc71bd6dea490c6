"""Work on each distinct word of a corpus once, and get the results back to all of its positions.

A task reads its documents in chunks. A chunk numbers its distinct words by frequency and keeps, for each document, the
numbers of its words by position. Two views of the same chunks go separate ways: the chunk's words, dealt by word over
the whole cluster, so that all chunks' copies of a word meet, and the documents' numbers, dealt by chunk. What is found
for a word goes back to the chunks that asked for it, and there numbers are replaced by results, position by position.
Nothing but a chunk's words and numbers is ever in one place, and words and numbers travel packed.

The two views read the documents twice, so these must come in the same order both times, as rows read from files do.
A chunk is known by a hash of what is in it: if the order changes all the same, the join finds it and fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from kmerweave.llm.hashing import span_hashes, together, word_spans

#: Documents of about so many words travel in one row.
ROW_WORDS = 1 << 17


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each for a process: many values are short, and making these costs more than using them."""
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def squeeze(data: bytes) -> bytes:
    return _zstd()[0].compress(data)


def expand(data: bytes) -> bytes:
    return _zstd()[1].decompress(data)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers below 2^32, byte by byte of all of them."""
    return squeeze(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def pack_bytes(values: list[bytes]) -> tuple[bytes, bytes]:
    return pack(np.fromiter(map(len, values), np.int64, len(values))), squeeze(b"".join(values))


def unpack_bytes(lengths: bytes, data: bytes) -> list[bytes]:
    ends, whole = np.cumsum(unpack(lengths)).tolist(), expand(data)
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


class Words:
    """How texts are read: as words between white space. Others override what differs."""

    #: A chunk ends with the document that brings it to so many bytes. Larger chunks repeat fewer words and take more
    #: memory.
    chunk_bytes = 12 << 20

    def spans(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """As ``hashing.word_spans``."""
        return word_spans(texts)

    #: Whether words have ``parts``.
    splits = False

    def parts(self, word: bytes) -> list[bytes] | None:
        """What a word consists of, if not of itself alone."""
        return None


class _Chunk:
    """Documents of one chunk, its distinct words by falling frequency, and the number of the word at each position."""

    def __init__(self, ids: list, texts: list[bytes], counted: list[bool], reader: Words, with_words: bool):
        self.ids, key = ids, xxhash.xxh64(repr(ids).encode())
        pieces, hashes, sizes = [], [], []
        for _, some in together((None, t) for t in texts):
            data, starts, ends, first = reader.spans(some)
            key.update(data)
            hashes.append(span_hashes(data, starts, ends))
            pieces.append((data, starts.astype(np.uint32), ends.astype(np.uint32)))
            sizes.append(np.diff(first))
        self.key, self.sizes, self.words = key.intdigest() - (1 << 63), np.concatenate(sizes), None
        self.hashes, at, self.numbers = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        if reader.splits:
            self.words = _spans(pieces, at)
            self._split(reader)
        counts = np.bincount(self.numbers, minlength=len(self.hashes))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        if not all(counted):
            weights = np.repeat(np.array(counted, np.int64), self.sizes)
            counts = np.bincount(self.numbers, weights, minlength=len(order)).astype(np.int64)
        self.hashes, self.counts, self.numbers = self.hashes[order], counts[order], rank[self.numbers]
        if self.words is not None:
            self.words = [self.words[k] for k in order.tolist()]
        elif with_words:
            self.data, self.starts, self.lengths = _places(pieces, at[order])

    def packed(self, numbers: np.ndarray) -> tuple[bytes, bytes]:
        """The words with these numbers, as by ``pack_bytes``."""
        if self.words is not None:
            return pack_bytes([self.words[k] for k in numbers.tolist()])
        return pack(self.lengths[numbers]), squeeze(gather(self.starts, self.lengths, self.data, numbers).tobytes())

    def _split(self, reader: Words):
        """Replaces words by their parts."""
        number: dict[bytes, int] = {}
        flat, lengths = [], np.ones(len(self.words), np.int64)
        for k, word in enumerate(self.words):
            parts = reader.parts(word)
            if parts is None:
                flat.append(number.setdefault(word, len(number)))
            else:
                lengths[k] = len(parts)
                flat += [number.setdefault(x, len(number)) for x in parts]
        taken = lengths[self.numbers]
        until = np.concatenate([[0], np.cumsum(taken)])[np.concatenate([[0], np.cumsum(self.sizes)])]
        self.numbers = gather(np.cumsum(lengths) - lengths, lengths, np.array(flat, np.uint32), self.numbers)
        self.words, self.sizes = list(number), np.diff(until)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))


def _spans(pieces: list, at: np.ndarray) -> list[bytes]:
    """The bytes of the spans with the given places in all pieces' spans."""
    words, until = [b""] * len(at), np.cumsum([0] + [len(starts) for _, starts, _ in pieces])
    piece = np.searchsorted(until, at, side="right") - 1
    for p, (data, starts, ends) in enumerate(pieces):
        mine = np.flatnonzero(piece == p)
        spots = at[mine] - until[p]
        for k, a, b in zip(mine.tolist(), starts[spots].tolist(), ends[spots].tolist()):
            words[k] = data[a:b]
    return words


def _places(pieces: list, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces' bytes, and where there the spans with the given places begin and how long they are."""
    until, offsets = (np.cumsum([0] + [len(x[k]) for x in pieces]) for k in (1, 0))
    starts, ends = (np.concatenate([x[k] for x in pieces])[at].astype(np.int64) for k in (1, 2))
    data = np.frombuffer(b"".join(x[0] for x in pieces), np.uint8)
    return data, starts + offsets[np.searchsorted(until, at, side="right") - 1], ends - starts


def _chunks(batches: Iterable[pa.RecordBatch], reader: Words, with_words: bool) -> Iterator[_Chunk]:
    ids, texts, counted, positions, size = [], [], [], [], 0

    def chunk():
        found = _Chunk(ids, texts, counted, reader, with_words)
        found.positions = positions
        return found

    for batch in batches:
        if "position" in batch.schema.names:
            places = batch.column("position").to_pylist()
        else:
            places = [None] * batch.num_rows
        counts = batch.column("counted").to_pylist() if "counted" in batch.schema.names else [True] * batch.num_rows
        for doc_id, text, count, place in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), counts, places):
            ids.append(doc_id)
            texts.append(text)
            counted.append(count)
            positions.append(place)
            size += len(text)
            if size >= reader.chunk_bytes:
                yield chunk()
                ids, texts, counted, positions, size = [], [], [], [], 0
    if ids:
        yield chunk()


def word_rows(texts: DataFrame, reader: Words, buckets: int) -> DataFrame:
    """``(bucket, chunk, steps, counts, lengths, words)``: of each chunk and bucket of words, the words, the steps
    between their numbers and how often the chunk has them, in documents that are ``counted`` if there is that column."""
    def rows(batches):
        for chunk in _chunks(batches, reader, with_words=True):
            bucket = (chunk.hashes % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
            for numbers in np.split(by_bucket, cuts) if len(bucket) else []:
                lengths, data = chunk.packed(numbers)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([bucket[numbers[0]]], pa.int32()), "chunk": [chunk.key],
                    "steps": [pack(np.diff(numbers, prepend=0))], "counts": [pack(chunk.counts[numbers])],
                    "lengths": [lengths], "words": [data]})

    return texts.mapInArrow(
        rows, "bucket int, chunk bigint, steps binary, counts binary, lengths binary, words binary")


def document_rows(texts: DataFrame, reader: Words) -> DataFrame:
    """``(chunk, ids, sizes, numbers)``: of some documents of a chunk the ids, how many words each has, and these
    words' numbers. If texts have a ``position``, there are ``positions`` too."""
    placed = "position" in texts.columns

    def rows(batches):
        for chunk in _chunks(batches, reader, with_words=False):
            ends = np.cumsum(chunk.sizes)
            part = ends // ROW_WORDS
            first = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(first, [*first[1:], len(ends)]):
                start = ends[a - 1] if a else 0
                yield pa.RecordBatch.from_pydict({
                    "chunk": [chunk.key], "ids": pa.array([chunk.ids[a:b]], pa.list_(pa.int64())),
                    "sizes": [pack(chunk.sizes[a:b])], "numbers": [pack(chunk.numbers[start:ends[b - 1]])]}
                    | ({"positions": pa.array([chunk.positions[a:b]], pa.list_(pa.float64()))} if placed else {}))

    return texts.mapInArrow(rows, "chunk bigint, ids array<bigint>, sizes binary, numbers binary"
                            + (", positions array<double>" if placed else ""))


def numbers_of(steps: bytes) -> np.ndarray:
    return np.cumsum(unpack(steps))


def reassemble(documents: DataFrame, found: DataFrame, build: Callable, schema: str) -> DataFrame:
    """Joins ``document_rows`` with the rows ``found`` for their chunks' words. ``build(found)`` gets all of a chunk's
    found rows and returns a function of ``(ids, sizes, numbers)``, and of ``positions`` if there are any, which makes a
    record batch of each row."""
    def join(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("the documents came in another order when they were read again; write them to a table first")
        rows = left.to_pylist()
        if not right.num_rows and any(len(unpack(r["sizes"])) and unpack(r["sizes"]).any() for r in rows):
            raise ValueError("the documents came in another order when they were read again; write them to a table first")
        make = build(right)
        return pa.Table.from_batches([
            make(r["ids"], unpack(r["sizes"]), unpack(r["numbers"]), *([r["positions"]] if "positions" in r else []))
            for r in rows])

    return documents.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(join, schema)


def gather(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The values of each number (``lengths`` from ``starts`` on), one after another."""
    sizes = lengths[numbers]
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[numbers] - ends + sizes, sizes)]


def buckets_of(texts: DataFrame) -> int:
    return 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt_by_word(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket")


def ids_by_chunk(words: DataFrame, encoder: Callable[[], Callable[[list[bytes]], list]]) -> DataFrame:
    """``(chunk, steps, lengths, ids)``: the token ids of each chunk's words. ``encoder()`` gives a task's function
    from words to ids, or to these as little-endian unsigned 32-bit integers; it gets every distinct word once."""
    def encode(batches):
        known, function = {}, encoder()
        for batch in batches:
            for row in batch.to_pylist():
                asked = unpack_bytes(row["lengths"], row["words"])
                new = [w for w in asked if w not in known]
                for word, ids in zip(new, function(new) if new else []):
                    known[word] = ids if isinstance(ids, bytes) else np.array(ids, "<u4").tobytes()
                found = [known[w] for w in asked]
                lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
                yield pa.RecordBatch.from_pydict({
                    "chunk": [row["chunk"]], "steps": [row["steps"]], "lengths": [pack(lengths)],
                    "ids": [pack(np.frombuffer(b"".join(found), "<u4"))]})

    asked = words.select("bucket", "chunk", "steps", "lengths", "words")
    return dealt_by_word(asked).mapInArrow(encode, "chunk bigint, steps binary, lengths binary, ids binary")


def encoded(texts: DataFrame, reader: Words, encoder, form="array", bounds=None) -> DataFrame:
    """``(doc_id, ids)`` of ``texts (doc_id, text)``: the token ids of all words, by position. ``form``:
    ``array``; ``bytes``, little-endian unsigned 32-bit integers one after another; or ``packed``, as by ``pack``.
    With ``bounds`` on ids there is the column ``part``: how many of them are below the id (0 for null)."""
    def build(found: pa.Table):
        rows = found.to_pylist()
        numbers = np.concatenate([np.zeros(0, np.int64), *[numbers_of(r["steps"]) for r in rows]])
        lengths = np.concatenate([np.zeros(0, np.int64), *[unpack(r["lengths"]) for r in rows]])
        values = np.concatenate([np.zeros(0, np.int64), *[unpack(r["ids"]) for r in rows]]).astype(np.int32)
        starts_by, lengths_by = (np.zeros(numbers.max(initial=-1) + 1, np.int64) for _ in range(2))
        starts_by[numbers], lengths_by[numbers] = np.cumsum(lengths) - lengths, lengths

        def make_batch(ids, sizes, words, positions=None):
            tokens = gather(starts_by, lengths_by, values, words)
            until = np.concatenate([[0], np.cumsum(lengths_by[words])])
            edges = until[np.concatenate([[0], np.cumsum(sizes)])]
            if form == "array":
                column = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(tokens, pa.int32()))
            else:
                one = pack if form == "packed" else lambda x: x.astype("<u4").tobytes()
                column = pa.array([one(tokens[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())
            found = [pa.array(ids, pa.int64()), column]
            if bounds is not None:
                below = np.searchsorted(bounds, np.array([-1 << 63 if i is None else i for i in ids], np.int64))
                found.append(pa.array(below, pa.int32()))
            names = ["doc_id", "ids", "part"][:len(found)]
            if positions is not None:
                found, names = [*found, pa.array(positions, pa.float64())], [*names, "position"]
            return pa.RecordBatch.from_arrays(found, names=names)

        return make_batch

    words = ids_by_chunk(word_rows(texts, reader, buckets_of(texts)), encoder)
    return reassemble(document_rows(texts, reader), words, build,
                      f"doc_id bigint, ids {'array<int>' if form == 'array' else 'binary'}"
                      + (", part int" if bounds is not None else "")
                      + (", position double" if "position" in texts.columns else ""))
