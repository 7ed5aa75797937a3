"""Problem 9: passages of held-out test items inside a training corpus.

Method: n-gram seeds, then Smith-Waterman alignment.  The seeds of an item are, for every window of consecutive words, its
rarest run of SEED words that the corpus holds, rarity being the number of corpus documents that hold the run (counted
over all documents).  A document that holds a seed is aligned with the seed's items word by word (match 2, mismatch and
gap -1); the longest run of equal words inside the aligned part decides whether a whole window leaked.

``alignments`` takes windows of SEED words, so every run is a seed: an edited copy is found if one run of SEED words is
left of it, whatever else the corpus holds.  ``leaked`` takes windows of WINDOW words: every text that holds one holds
its seed, so no choice of seeds loses one, however often a passage leaked.

The items are the bounded side.  They go to every task only in blocks of at most BLOCK_WORDS words; more items make
more scans of the corpus, never a larger broadcast.  Documents are never shuffled: both passes are narrow scans, and only
counts of the items' own runs are added up.  A passage leaked into a third of all documents only makes more rows.

Defined results: null and empty texts on either side give no rows; items shorter than the window are only found by
``alignments``; items with equal passages are all reported; repeated rows give one row per (doc_id, item_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import texts_of
from folioforge.llm.textcore import U64, run_hashes, word_hashes

WINDOW, SEED, BLOCK_WORDS = 12, 5, 1 << 21
MATCH, OTHER = 2, 1


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int]]:
    """Per pair of word sequences (a, b): (best local score, longest equal run, start and stop of the best part in b).

    All pairs of a call are aligned side by side, one word of every ``a`` at a time; give pairs of like lengths.
    """
    p, n, m = len(pairs), max(len(b) for _, b in pairs), max(len(a) for a, _ in pairs)
    first, second = np.zeros((p, m), U64), np.zeros((p, n), U64)
    for k, (a, b) in enumerate(pairs):
        first[k, : len(a)], second[k, : len(b)] = a, b
    lengths = np.array([[len(a), len(b)] for a, b in pairs])
    real = np.arange(n) < lengths[:, 1:]
    places = np.arange(n + 1, dtype=np.int32)
    step = OTHER * places
    rows = np.arange(p)
    up = np.zeros((p, n + 1), np.int32)
    begin_up = np.tile(places, (p, 1))  # where the alignment that ends here began in b
    run = np.zeros((p, n + 1), np.int32)
    best, longest, start, stop = (np.zeros(p, np.int32) for _ in range(4))
    for i in range(m):
        same = (second == first[:, i : i + 1]) & real & (i < lengths[:, :1])
        h = np.zeros((p, n + 1), np.int32)
        h[:, 1:] = up[:, :-1] + np.where(same, MATCH, -OTHER)
        begin = begin_up.copy()
        begin[:, 1:] = begin_up[:, :-1]
        gap = up - OTHER
        take = gap > h
        np.copyto(h, gap, where=take)
        np.copyto(begin, begin_up, where=take)
        none = h <= 0
        h[none] = 0
        np.copyto(begin, places, where=none)
        # gaps along b: the best earlier cell, each step costing OTHER
        lifted = h + step
        reach = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == reach, places, 0), axis=1)
        h = reach - step
        begin = np.take_along_axis(begin, source, 1)
        new = np.zeros_like(run)
        new[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        run = new
        longest = np.maximum(longest, run.max(1))
        at = h.argmax(1)
        top = h[rows, at]
        better = top > best
        best[better], start[better], stop[better] = top[better], begin[rows, at][better], at[better]
        up, begin_up = h, begin
    return list(zip(best.tolist(), longest.tolist(), start.tolist(), stop.tolist(), strict=True))


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 15) -> list[tuple[int, int, int, int]]:
    """``smith_waterman`` of any number of pairs, in groups of like lengths."""
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    at = 0
    while at < len(order):
        size = 1
        while at + size < len(order) and (size + 1) * len(pairs[order[at + size]][1]) <= cells and len(pairs[order[at + size]][1]) <= 1.3 * len(pairs[order[at]][1]) + 16:
            size += 1
        own = order[at : at + size]
        for k, result in zip(own, smith_waterman([pairs[k] for k in own]), strict=True):
            out[k] = result
        at += size
    return out


class Items:
    """A block of items: their words and, once counts are known, their seeds."""

    def __init__(self, ids: list[int], texts: list[str], window: int):
        self.ids, self.window = ids, window
        self.words, self.offsets = word_hashes(texts)
        self.runs, self.run_offsets = run_hashes(self.words, self.offsets, SEED)
        self.grams = np.unique(self.runs)

    def choose(self, counts: np.ndarray) -> None:
        """Seeds from the corpus counts of ``grams``: the rarest run of every window that occurs, the whole text if shorter."""
        seeds, owners = [], []
        for i in range(len(self.ids)):
            own = self.runs[self.run_offsets[i] : self.run_offsets[i + 1]]
            if not len(own):
                continue
            count = counts[np.searchsorted(self.grams, own)]
            span = min(self.window - SEED + 1, len(own))
            order = np.lexsort((own, count, count == 0))  # runs that no document holds join nothing: last, and left out
            rank = np.empty(len(own), np.int64)
            rank[order] = np.arange(len(own))
            windows = np.lib.stride_tricks.sliding_window_view(rank, span)
            best = order[np.unique(windows.min(1))]
            chosen = np.unique(own[best[count[best] > 0]])
            seeds.append(chosen)
            owners.append(np.full(len(chosen), i))
        seed, owner = (np.concatenate(x) for x in (seeds, owners)) if seeds else (np.zeros(0, U64), np.zeros(0, np.int64))
        order = np.lexsort((owner, seed))
        self.seed, self.owner = seed[order], owner[order]

    def stretches(self, runs: np.ndarray, length: int) -> dict[int, list[tuple[int, int]]]:
        """Per item with a seed among a document's runs, the stretches of its words that an alignment through such a seed
        can reach, joined where they meet.

        A match scores MATCH and a word beside it costs OTHER, so an alignment that scores at all spans at most
        1 + MATCH / OTHER words for each word of the item, on either side of the seed.
        """
        lo, hi = np.searchsorted(self.seed, runs), np.searchsorted(self.seed, runs, "right")
        out: dict[int, list[tuple[int, int]]] = {}
        for at in np.flatnonzero(hi > lo).tolist():
            for i in self.owner[lo[at] : hi[at]].tolist():
                reach = (1 + MATCH // OTHER) * int(self.offsets[i + 1] - self.offsets[i])
                a, b = max(0, at - reach), min(length, at + SEED + reach)
                own = out.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1] = (own[-1][0], max(b, own[-1][1]))
                else:
                    own.append((a, b))
        return out


def _counts(documents: DataFrame, items: Items) -> np.ndarray:
    """For each run of the items the number of documents that hold it."""
    grams = items.grams

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(len(grams), np.int64)
        for batch in batches:
            h, at = run_hashes(*word_hashes(texts_of(batch, 0)), SEED)
            if not len(h) or not len(grams):
                continue
            k = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
            hit = grams[k] == h
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[hit]
            total += np.bincount(np.unique(doc * len(grams) + k[hit]) % len(grams), minlength=len(grams))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "c"])

    out = np.zeros(len(grams), np.int64)
    for row in documents.mapInArrow(run, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c")).collect():
        out[row.k] = row.c  # at most one row per run of the block
    return out


def alignments(documents: DataFrame, items: DataFrame, window: int = SEED, min_score: int = 2 * SEED) -> DataFrame:
    """(doc_id, item_id, score, longest_run, first_word, last_word) of every pair whose best alignment through a seed scores at
    least ``min_score``; of a long document only the words around its seeds are aligned."""
    rows = items.select("item_id", "text").where("text is not null and item_id is not null").distinct().orderBy("item_id").toLocalIterator()
    blocks: list[tuple[list[int], list[str]]] = [([], [])]
    size = 0
    for r in rows:
        size += len(r.text) // 3
        if size > BLOCK_WORDS and blocks[-1][0]:
            blocks.append(([], []))
            size = len(r.text) // 3
        blocks[-1][0].append(r.item_id)
        blocks[-1][1].append(r.text)
    source = documents.select("doc_id", "text").where("text is not null")
    schema = "doc_id bigint, item_id bigint, score int, longest_run int, first_word int, last_word int"
    out = None
    for ids, texts in blocks:
        block = Items(ids, texts, window)
        block.choose(_counts(source.select("text"), block))

        def run(batches: Iterator[pa.RecordBatch], block=block):
            for batch in batches:
                words, at = word_hashes(texts_of(batch, 1))
                runs, run_at = run_hashes(words, at, SEED)
                k = np.minimum(np.searchsorted(block.seed, runs), max(0, len(block.seed) - 1))
                seeded = block.seed[k] == runs if len(block.seed) else np.zeros(len(runs), bool)
                docs = np.unique(np.searchsorted(run_at, np.flatnonzero(seeded), "right") - 1)
                doc_ids = batch.column(0).to_pylist()
                wanted = [(d, i, a, b) for d in docs.tolist() for i, own in block.stretches(runs[run_at[d] : run_at[d + 1]], int(at[d + 1] - at[d])).items() for a, b in own]
                results = aligned([(block.words[block.offsets[i] : block.offsets[i + 1]], words[at[d] + a : at[d] + b]) for d, i, a, b in wanted])
                best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
                for (d, i, a, _), (score, longest, start, stop) in zip(wanted, results, strict=True):
                    score0, longest0, *rest = best.get((d, i), (-1, 0, 0, 0))
                    best[d, i] = (score, max(longest, longest0), start + a, stop + a) if score > score0 else (score0, max(longest, longest0), *rest)
                found = [(doc_ids[d], block.ids[i], *r) for (d, i), r in sorted(best.items()) if r[0] >= min_score]
                if found:
                    columns = list(zip(*found, strict=True))
                    kinds = [pa.int64(), pa.int64()] + [pa.int32()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "longest_run", "first_word", "last_word"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def leaked(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id): documents that contain at least ``window`` consecutive words of the item."""
    return alignments(documents, items, window).where(F.col("longest_run") >= window).select("doc_id", "item_id").distinct()
