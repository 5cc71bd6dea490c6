"""Byte-level BPE: encoding and decoding of whole texts with the ranks of a public tokenizer.

The text splits into pre-tokens by a pattern, and each is encoded by itself. Every distinct pre-token of the corpus is
encoded once, after a shuffle of all chunks' distinct pre-tokens by word (see ``distinct``); ids return to the chunks and
fall into place by position. Decoding looks each id up in the table of token bytes.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

from kmerweave.llm import distinct
from kmerweave.llm.common import texts_of

#: White space outside ASCII, as UTF-8: single letters, and those that begin with the same two bytes.
_WIDE_SPACES = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_MORE_SPACES = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")


def _has_wide_space(data: bytes) -> bool:
    """Plain searches, as a pattern with alternatives looks at every byte."""
    return any(x in data for x in _WIDE_SPACES) or b"\xe2\x80" in data and _MORE_SPACES.search(data) is not None


class Segments(distinct.Words):
    """Cuts a text before each space that follows something else than white space. No pre-token reaches over such a
    cut, and what a segment splits into depends on it alone."""

    chunk_bytes = 16 << 20

    def spans(self, texts):
        whole = b"".join(texts)
        data = np.frombuffer(whole, np.uint8)
        solid = (data > 32) & (data != 127)
        if _has_wide_space(whole):
            solid &= data < 128
        bounds = np.cumsum([0] + [len(t) for t in texts])
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (data[1:] == 32) & solid[:-1]
        cut[bounds] = True
        edges = np.flatnonzero(cut)
        return whole, edges[:-1], edges[1:], np.searchsorted(edges[:-1], bounds)


class PreTokens(Segments):
    """Segments split by a pre-token pattern. With ``plain`` that is known to leave a run of letters after at most one
    space whole, and to cut one full stop or comma after it off, as GPT-2's pattern does; the rest is left to it."""

    splits, chunk_bytes = True, 8 << 20

    def __init__(self, pattern: str, plain=True, chunk_bytes=None):
        self.pattern, self.plain = regex.compile(pattern), plain
        self.chunk_bytes = chunk_bytes or self.chunk_bytes

    def parts(self, word):
        text = word.decode()
        body = text[1:] if text[0] == " " else text
        if self.plain and body.isalpha():
            return None
        if self.plain and body[-1:] in (",", ".") and body[:-1].isalpha():
            return [word[:-1], word[-1:]]
        return [w.encode() for w in self.pattern.findall(text)]


def ranks(path: str) -> dict[bytes, int]:
    """The table of token bytes from a rank file: a line for each token, its bytes in base 64 and its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode(docs: DataFrame, table: dict[bytes, int], pattern: str, id_col="doc_id", text_col="text", form="array",
           position_col=None, chunk_bytes=None) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs``, ids in a ``form`` of ``distinct.encoded``; a null or empty text has none. Special tokens' strings are
    ordinary text. Rows without id and repeated rows are encoded like any other.

    ``table`` holds the token bytes and is of fixed size; it travels with the tasks. ``docs`` must come in the same
    order each time it is read, as rows from files do. A ``position_col`` comes along as the double ``position``. Tasks
    take ``chunk_bytes`` of text at a time: fewer need less memory, and have more distinct words to pass on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def encoder():
        tokenizer = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=shared.value, special_tokens={})
        return lambda words: [tokenizer.encode_ordinary(w.decode()) for w in words]

    texts = texts_of(docs, id_col, text_col)
    if position_col:
        texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(
            docs[text_col].cast("binary"), F.lit(b"")).alias("text"), docs[position_col].cast("double").alias("position"))
    return distinct.encoded(texts, PreTokens(pattern, chunk_bytes=chunk_bytes), encoder, form)


def decode(encoded: DataFrame, table: dict[bytes, int], ids_col="ids", out_col="bytes") -> DataFrame:
    """``encoded`` with the bytes of all its tokens as ``out_col``; ids are an array or, as ``bytes``, little-endian
    unsigned 32-bit integers. An id that the table lacks is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in table.items()})
    binary = isinstance(encoded.schema[ids_col].dataType, BinaryType)

    @F.arrow_udf(BinaryType())
    def joined(ids: pa.Array) -> pa.Array:
        token = shared.value.__getitem__
        lists = (np.frombuffer(x.as_buffer(), "<u4").tolist() if binary else x.as_py() for x in ids)
        return pa.array([b"".join(map(token, x)) for x in lists], pa.binary())

    return encoded.withColumn(out_col, joined(F.col(ids_col)))
