"""Problem 5: cutting oversized texts at natural boundaries, with overlap.

Method: pointer doubling.  Every boundary of a text (paragraph end, sentence end, blank, and fillers inside
long runs without blanks) gets its farthest legal successor, overlap included, by binary search; squaring
that successor table again and again yields all greedy cuts of a text in log2(pieces) vector steps.

A piece has at most ``limit`` characters (code points).  From the start of a piece its end is the farthest
paragraph end in the last half of the window, else the farthest sentence end there, else the farthest blank
there, else the farthest boundary of any kind.  The next piece starts at the first boundary at or after
``end - overlap``, so consecutive pieces share about ``overlap`` characters, never more.

Defined results: null, empty and fitting texts give one piece (null gives none when ``oversized_only``);
rows that repeat an id with equal text count once; pieces hold every character of the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import per_batch, texts_of

LIMIT, OVERLAP = 4000, 200
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’»」)\]]*\s+|[。！？][」』]*")
_BLANK = re.compile(r"\s+")
PIECE_SCHEMA = "id string, piece int, start int, stop int, text string"


def boundaries(text: str, filler: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rank): sorted cut positions with 0 and the end; rank 0 paragraph, 1 sentence, 2 blank, 3 filler."""
    n = len(text)
    rank: dict[int, int] = {}
    for level, pattern in ((2, _BLANK), (1, _SENTENCE), (0, _PARAGRAPH)):
        rank.update((m.end(), level) for m in pattern.finditer(text))
    rank[0] = rank[n] = 0
    own = np.array(sorted(rank), np.int64)
    gap = np.diff(own)
    for i in np.flatnonzero(gap > filler).tolist():
        for p in range(int(own[i]) + filler, int(own[i + 1]), filler):
            rank[p] = 3
    at = np.array(sorted(rank), np.int64)
    return at, np.array([rank[p] for p in at.tolist()], np.int8)


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The (start, stop) of every piece, in order."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    at, rank = boundaries(text, max(1, overlap // 2))
    m = len(at)
    reach = at + limit
    stop = np.searchsorted(at, reach, "right") - 1  # the farthest boundary of any kind
    chosen = np.zeros(m, bool)
    for level in (0, 1, 2):
        own = np.flatnonzero(rank <= level)
        far = own[np.searchsorted(at[own], reach, "right") - 1]
        good = ~chosen & (at[far] > at + limit // 2)
        stop[good] = far[good]
        chosen |= good
    last = at + limit >= n
    stop[last] = m - 1
    following = np.minimum(np.searchsorted(at, at[stop] - overlap, "left"), m - 1)
    following = np.maximum(following, np.minimum(np.arange(m) + 1, m - 1))  # always forward
    following[stop == m - 1] = m - 1  # the end is its own successor
    starts, table = np.zeros(1, np.int64), following
    while not (table[starts] == m - 1).all():  # pointer doubling: after step j the first 2^j starts are there
        starts = np.unique(np.concatenate((starts, table[starts])))
        table = table[table]
    starts = np.unique(starts)
    starts = starts[starts < m - 1]
    return list(zip(at[starts].tolist(), at[stop[starts]].tolist(), strict=True))


def split(stories: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "id", text_col: str = "body_text", oversized_only: bool = True) -> DataFrame:
    """(id, piece, start, stop, text) of every text; with ``oversized_only`` of those over the limit.

    The length test runs in the scan, so texts that fit never reach Python.  Repeated ids collapse after
    the cutting, on (id, piece, start, stop) with equal text.
    """

    def run(batch: pa.RecordBatch):
        for key, text in zip(texts_of(batch, 0), texts_of(batch, 1), strict=True):
            spans = cut_points(text or "", limit, overlap)
            k = len(spans)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * k, pa.string()), pa.array(range(k), pa.int32()), pa.array([a for a, _ in spans], pa.int32()), pa.array([b for _, b in spans], pa.int32()), pa.array([(text or "")[a:b] for a, b in spans], pa.string())],
                names=["id", "piece", "start", "stop", "text"],
            )

    source = stories.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    source = source.where(F.length("t") > limit) if oversized_only else source.where(F.col("t").isNotNull())
    return source.mapInArrow(per_batch(run), PIECE_SCHEMA).dropDuplicates(["id", "piece", "start", "stop"])


def oversized(stories: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id) of the stories that the splitter cuts."""
    source = stories.select("id", "body_text")

    def run(batch: pa.RecordBatch):
        ids = [key for key, text in zip(texts_of(batch, 0), texts_of(batch, 1), strict=True) if len(cut_points(text, limit, overlap)) > 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string())], names=["id"])

    return source.where(F.length("body_text") > limit).mapInArrow(per_batch(run), "id string").distinct()
