"""Token ids in Arrow files with fixed-size lists: random access to sequences of equal length, without a copy.

A file holds record batches of ``SEQUENCES`` rows. A row is one sequence: ``ids``, ``LENGTH`` unsigned integers of 16 bits
or, where the vocabulary asks for it, 32; ``mask``, ``LENGTH`` bits, true for a token and false for padding; and
``doc_ids`` and ``doc_ends``, the documents that end in it and where. Row ``n`` of a file is in batch
``n // SEQUENCES``, at a fixed offset.

Documents are dealt by ranges of ids. A first job leaves them sorted within each range, many to a row, as ids of one
document alone compress less, and in a second one each task
writes the ranges that it reads, one file each, under names of its own. It lists a file once that is complete, so a task
that runs again leaves no half or double file in the list. Documents run on from sequence to sequence; only a file's last
sequence has padding.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from kmerweave.llm import distinct
from kmerweave.llm.byte_bpe import Segments
from kmerweave.llm.common import cut_lineage, partitions, scratch_path, shuffles_end_with_jobs, texts_of

LENGTH, SEQUENCES = 1024, 256
#: Segments in a call's text, and texts in a call.
TOGETHER, BATCH = 64, 256
END = 0
#: Ids of about so many lie in one row between the two jobs.
ROW_IDS = 1 << 14


def schema(vocabulary: int) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH)),
                      ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int32()))])


def encoder_of(tokenizer: Tokenizer):
    """A function from segments (``byte_bpe.Segments``) to their ids as bytes, for a byte-level tokenizer. A call for one
    segment costs more than its encoding, so segments that begin with a space and end with something else go together:
    that is where texts are cut, too. Tokens stand for as many bytes as they have characters, which tells whose they are."""
    vocabulary = tokenizer.get_vocab()
    sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    for token, number in vocabulary.items():
        sizes[number] = len(token)

    def ids_of(texts):
        found = tokenizer.encode_batch_fast([b"".join(t).decode() for t in texts], add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def encode(words):
        for at in range(0, len(words), TOGETHER * BATCH):
            some = words[at:at + TOGETHER * BATCH]
            inner = [w for w in some if w[:1] == b" " and 32 < w[-1] < 127]
            groups = [inner[k:k + TOGETHER] for k in range(0, len(inner), TOGETHER)]
            known, alone = {}, [w for w in some if not (w[:1] == b" " and 32 < w[-1] < 127)]
            for group, ids in zip(groups, ids_of(groups)):
                ends, wanted = np.cumsum(sizes[ids]), np.cumsum([len(w) for w in group])
                cuts = np.searchsorted(ends, wanted) + 1
                if cuts[-1] == len(ids) and (ends[cuts - 1] == wanted).all():
                    data, cuts = ids.tobytes(), (4 * cuts).tolist()
                    known.update(zip(group, (data[a:b] for a, b in zip([0, *cuts], cuts))))
                else:
                    alone += group
            for k in range(0, len(alone), BATCH):
                part = alone[k:k + BATCH]
                known.update(zip(part, (ids.tobytes() for ids in ids_of([[w] for w in part]))))
            yield from (known[w] for w in some)

    return encode


def tokenized(docs: DataFrame, tokenizer_json: str, id_col="doc_id", text_col="text") -> DataFrame:
    """``(doc_id, ids, part)`` of every row by the tokenizers library, without special tokens; strings of special tokens are
    ordinary text. The ids are packed (``distinct.pack``), and ``part`` numbers ranges of document ids with about as many
    documents each. ``tokenizer_json`` is the content of a byte-level tokenizer's file."""
    parts = partitions(docs.sparkSession)
    shares = [k / parts for k in range(1, parts)]
    bounds = np.array(docs.select(docs[id_col].cast("double").alias("id")).approxQuantile("id", shares, 0.2 / parts))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def encoder():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        tokenizer = Tokenizer.from_str(shared.value)
        tokenizer.encode_special_tokens = True
        return encoder_of(tokenizer)

    return distinct.encoded(texts_of(docs, id_col, text_col), Segments(), encoder, "packed", bounds)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


class _Writer:
    """Fills sequences and writes them batch by batch; holds one batch."""

    def __init__(self, out, layout: pa.Schema):
        self.out, self.layout = out, layout
        self.file = pa.ipc.new_file(out, layout)
        self.room = LENGTH * SEQUENCES
        self.start()

    def start(self):
        self.ids = np.zeros(self.room, self.layout.field("ids").type.value_type.to_pandas_dtype())
        self.ended, self.used = [], 0

    def add(self, doc_id, tokens: np.ndarray):
        done = 0
        while done < len(tokens):
            take = min(len(tokens) - done, self.room - self.used)
            self.ids[self.used:self.used + take] = tokens[done:done + take]
            done, self.used = done + take, self.used + take
            if done == len(tokens):
                self.ended.append((self.used - 1, doc_id))
            if self.used == self.room:
                self.flush()

    def flush(self):
        rows = -(-self.used // LENGTH)
        if rows:
            ends = np.array([at for at, _ in self.ended], np.int64)
            offsets = pa.array(np.searchsorted(ends // LENGTH, np.arange(rows + 1)), pa.int32())
            fixed = [pa.array(self.ids[:rows * LENGTH]), pa.array(np.arange(rows * LENGTH) < self.used)]
            lists = [pa.array([d for _, d in self.ended], pa.int64()), pa.array(ends % LENGTH, pa.int32())]
            self.file.write_batch(pa.RecordBatch.from_arrays(
                [*(pa.FixedSizeListArray.from_arrays(x, LENGTH) for x in fixed),
                 *(pa.ListArray.from_arrays(offsets, x) for x in lists)], schema=self.layout))
        self.start()

    def close(self, listed: dict) -> pa.RecordBatch:
        self.flush()
        self.file.close()
        self.out.close()
        return pa.RecordBatch.from_pylist([listed], pa.schema([
            ("part", pa.int32()), ("first", pa.int64()), ("path", pa.string()), ("n_tokens", pa.int64())]))


def _many_to_a_row(kind: np.dtype):
    """From rows ``(doc_id, ids, part)`` in order to rows ``(part, doc_ids, sizes, ids)`` of successive documents."""
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, doc_ids, found, size = None, [], [], 0

        def row():
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "sizes": [distinct.pack(np.fromiter(map(len, found), np.int64, len(found)))],
                "ids": [distinct.squeeze(np.concatenate(found).tobytes())]})

        for batch in batches:
            for of, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if doc_ids and (of != part or size >= ROW_IDS):
                    yield row()
                    doc_ids, found, size = [], [], 0
                part = of
                doc_ids.append(doc_id)
                found.append(distinct.unpack(ids).astype(kind))
                size += len(found[-1])
        if doc_ids:
            yield row()

    return rows


def write(encoded: DataFrame, folder: str, vocabulary: int) -> DataFrame:
    """Writes ``encoded (doc_id, ids, part)``, ids packed and ``part`` rising with them, in ascending order of ids, each
    document with the id ``END`` after it. Returns the list of files ``(part, first, path, n_tokens)``, which is in order
    by part and first id. Rows without id come first. ``folder`` is a path or address that all executors can write to;
    ids are below ``vocabulary``."""
    layout = schema(vocabulary)
    kind = np.dtype(layout.field("ids").type.value_type.to_pandas_dtype())

    def files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _store(folder)
        system.create_dir(root, recursive=True)
        now, writer, listed, before = None, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                part, sizes = row["part"], distinct.unpack(row["sizes"])
                if part != now:
                    if writer is not None:
                        yield writer.close(listed)
                    path = f"{root}/{part:06d}-{uuid.uuid4().hex}.arrow"
                    now, writer, before = part, _Writer(system.open_output_stream(path), layout), -1 << 63
                    listed = {"part": part, "first": None, "path": path, "n_tokens": 0}
                ids = np.frombuffer(distinct.expand(row["ids"]), kind)
                for doc_id, tokens in zip(row["doc_ids"], np.split(ids, np.cumsum(sizes)[:-1])):
                    place = -1 << 63 if doc_id is None else doc_id
                    if place < before:
                        raise ValueError("a range of documents was not read in the order in which it was written")
                    if listed["first"] is None:
                        listed["first"] = place
                    writer.add(doc_id, np.append(tokens, kind.type(END)))
                    before = place
                listed["n_tokens"] += len(ids) + len(sizes)
        if writer is not None:
            yield writer.close(listed)

    with shuffles_end_with_jobs(encoded.sparkSession):
        ordered = cut_lineage(
            encoded.repartition("part").sortWithinPartitions("part", "doc_id", "ids").select("part", "doc_id", "ids").mapInArrow(
                _many_to_a_row(kind), "part int, doc_ids array<bigint>, sizes binary, ids binary"), "token-ids")
        return cut_lineage(ordered.mapInArrow(files, "part int, first bigint, path string, n_tokens bigint"), "token-files")


def read_sequences(folder: str, path: str) -> pa.RecordBatchFileReader:
    """A file's reader; local files are mapped into memory, so rows are views of the file."""
    system, _ = _store(folder)
    local = isinstance(system, fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(path) if local else system.open_input_file(path))


def documents(files: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, ids)`` of the documents in the files that ``files`` lists: the ids with the end, as little-endian
    unsigned 32-bit integers, and how many ids all documents before have. A task holds one batch and one document."""
    ordered = Window.orderBy("part", "first").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    listed = files.withColumn("before", F.coalesce(F.sum("n_tokens").over(ordered), F.lit(0)))

    def read(batches):
        for batch in batches:
            for file in batch.to_pylist():
                reader, at, open_ids = read_sequences(folder, file["path"]), file["before"], []
                for n in range(reader.num_record_batches):
                    rows = reader.get_batch(n)
                    used = rows.column("mask").flatten().true_count
                    ids = rows.column("ids").flatten().to_numpy()[:used]
                    ends = rows.column("doc_ends")
                    row = np.repeat(np.arange(len(ends)), np.diff(ends.offsets.to_numpy()))
                    cuts = row * LENGTH + ends.flatten().to_numpy() + 1
                    found, starts = [], []
                    for piece in np.split(ids, cuts)[:-1]:
                        found.append(np.concatenate([*open_ids, piece]))
                        open_ids = []
                        starts.append(at)
                        at += len(found[-1])
                    rest = ids[cuts[-1] if len(cuts) else 0:]
                    if len(rest):
                        open_ids.append(rest)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_ids").flatten(), pa.array(starts, pa.int64()),
                         pa.array([f.astype("<u4").tobytes() for f in found], pa.binary())], names=["doc_id", "start", "ids"])

    return listed.repartition("path").mapInArrow(read, "doc_id bigint, start bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer_json: str, folder: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """Encodes ``docs``, writes the files (to a new folder beside the checkpoints, unless given) and reads them back:
    ``(doc_id, start, ids)`` of every row as ``documents`` does, repeated rows included. A null or empty text has the end alone."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    vocabulary = Tokenizer.from_str(tokenizer_json).get_vocab_size()
    return documents(write(tokenized(docs, tokenizer_json, id_col, text_col), folder, vocabulary), folder)
