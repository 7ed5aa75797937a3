"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary.

Method: forced-boundary splitting.  A pair of bytes that occurs inside no vocabulary token can never lie
inside an output token, so every such place between two characters is a certain cut for the merges.  It is used unless it
could change what the pre-tokeniser sees: not after a blank, nor before a blank that isn't ASCII (its only look-ahead concerns
runs of blanks), nor before an apostrophe, which a contraction may start with.  Inside a piece of the pre-tokeniser such a
cut does no harm, as nothing merges across it.  So the fragments encode independently and their ids concatenate to the ids of
the whole; texts without blanks are cut too.  Fragments repeat a lot; their ids are kept in a bounded table per Python worker.

Defined results: null and empty texts give an empty list; every input row gives one row; strings of
special tokens in a text are ordinary text; a null doc_id is kept.  A text without cuts is one fragment.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from folioforge.llm.common import per_batch, texts_of
from folioforge.llm.textcore import chunks, codepoints

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokeniser pattern of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments whose ids one worker remembers, and the longest that it remembers.
REMEMBERED, LONGEST = 1 << 19, 64
ASCII_BLANKS = (9, 10, 11, 12, 13, 32)


@lru_cache(4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(4)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})


def forced(ranks: dict[bytes, int]) -> np.ndarray:
    """[256, 256]: True where the two bytes are neighbours inside no token."""
    free = np.ones((256, 256), bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, np.uint8)
            free[b[:-1], b[1:]] = False
    return free


@lru_cache(4)
def cutter(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the last UTF-8 byte of each character that may stand before a cut, else 256; the first one of each that may stand
    behind it, else 256; cuts by [byte, byte])."""
    point = np.arange(0x110000, dtype=np.int64)
    last = np.where(point < 0x80, point, 0x80 | (point & 0x3F))
    first = np.select([point < 0x80, point < 0x800, point < 0x10000], [point, 0xC0 | point >> 6, 0xE0 | point >> 12], 0xF0 | point >> 18)
    blank = np.array([c for c in range(0x3001) if chr(c).isspace()] + [0x85])
    last[blank] = 256
    first[[c for c in blank.tolist() if c not in ASCII_BLANKS] + [ord("'")]] = 256
    allowed = np.zeros((257, 257), bool)
    allowed[:256, :256] = forced(ranks_of(path))
    return last.astype(np.int16), first.astype(np.int16), allowed


def cuts_of(texts: list[str], path: str) -> list[np.ndarray]:
    """Per text the certain cut positions, without 0 and the end."""
    last, first, allowed = cutter(path)
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        cp = codepoints("\x00".join(texts[a:b]))
        at = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        where = np.flatnonzero(allowed[last[cp[:-1]], first[cp[1:]]]) + 1 if len(cp) > 1 else np.zeros(0, np.int64)
        edge = np.searchsorted(where, at)
        for i in range(b - a):
            own = where[edge[i] : edge[i + 1]] - at[i]
            out.append(own[(own > 0) & (own < len(texts[a + i]))])
    return out


class FragmentEncoder:
    """Ids of texts, one fragment at a time, with a bounded memory of fragments."""

    def __init__(self, path: str = VOCABULARY):
        self.path, self.known = path, {}
        self.encode_piece = encoder(path).encode_ordinary

    def fragment(self, text: str) -> array:
        ids = array("i", self.encode_piece(text))
        if len(text) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = ids
        return ids

    def batch(self, texts: list[str | None]) -> tuple[array, list[int]]:
        """(ids of all texts, offsets)."""
        flat, offsets, known = array("i"), [0], self.known
        own = [t or "" for t in texts]
        for text, cut in zip(own, cuts_of(own, self.path), strict=True):
            if text:
                a = 0
                for b in cut.tolist():
                    piece = text[a:b]
                    ids = known.get(piece)
                    flat.extend(self.fragment(piece) if ids is None else ids)
                    a = b
                piece = text[a:]
                ids = known.get(piece)
                flat.extend(self.fragment(piece) if ids is None else ids)
            offsets.append(len(flat))
        return flat, offsets


@lru_cache(2)
def _worker(path: str) -> FragmentEncoder:
    return FragmentEncoder(path)


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row of ``documents``; a narrow, shuffle-free scan."""

    if os.path.exists(vocabulary):
        documents.sparkSession.sparkContext.addFile(vocabulary)  # executors needn't have it at the same place

    def run(batch: pa.RecordBatch):
        sent = SparkFiles.get(os.path.basename(vocabulary))
        flat, offsets = _worker(sent if os.path.exists(sent) else vocabulary).batch(texts_of(batch, 1))
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(per_batch(run), f"doc_id {kind}, ids array<int>")
