"""Vectorised word hashing shared by the text operators.

A *word* is a longest run of Unicode letters and digits, lower-cased.  A batch of texts is turned into
one code-point array; classes, lower-casing and per-character random values come from lookup tables, so
hashing runs at numpy speed instead of one Python object per word.  Hashes are 64-bit and equal exactly
when the words are (up to 64-bit chance).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Characters per numpy chunk; a longer single text makes a longer chunk.
CHUNK_CHARS = 1 << 18
_POW_BITS = 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x = x ^ (x >> U64(27))
    x = x * _MIX2
    return x ^ (x >> U64(31))


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is word character, random value of the lower-cased character, powers of an odd base)."""
    top = 0x110000
    word = np.zeros(top, bool)
    low = np.arange(top, dtype=np.uint32)
    for c in range(0x323B0):  # no letters or digits are assigned beyond
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalnum():
            word[c] = True
            lc = ch.lower()
            low[c] = ord(lc[0])
    low[0x3C2] = 0x3C3  # final sigma
    rnd = mix((low.astype(U64) + U64(1)) * U64(_MULT))
    power = np.ones(1 << _POW_BITS, U64)
    power[1:] = U64(0xD1342543DE82EF95)
    power = np.multiply.accumulate(power)
    return word, rnd, power


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS):
    """Yields (first, last) index ranges whose texts hold about ``limit`` characters together."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[str | None], spans: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets): words of text i are hashes[offsets[i]:offsets[i + 1]].

    To ``spans``, if given, go the first and last positions of the words in their texts.
    """
    word, rnd, power = tables()
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    for a, b in chunks(texts):
        own = [t or "" for t in texts[a:b]]
        cp = codepoints("\n".join(own))
        is_word = word[cp]
        edge = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
        starts, ends = edge[0::2], edge[1::2]
        at = np.cumsum([0] + [len(t) + 1 for t in own])
        counts[a + 1 : b + 1] = np.diff(np.searchsorted(starts, at))
        if not len(starts):
            continue
        length = ends - starts
        if spans is not None:
            base = at[np.searchsorted(at, starts, "right") - 1]
            spans.append((starts - base, ends - base))
        cum = np.concatenate(([0], np.cumsum(length)))
        inside = np.arange(cum[-1]) - np.repeat(cum[:-1], length)
        value = rnd[cp[is_word]] * power[inside & ((1 << _POW_BITS) - 1)]
        if length.max() >> _POW_BITS:
            value = value + (inside >> _POW_BITS).astype(U64)
        total = np.concatenate((np.zeros(1, U64), np.cumsum(value)))
        parts.append(mix(total[cum[1:]] - total[cum[:-1]] + length.astype(U64)))
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.cumsum(counts)


def run_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive words inside one text, and their offsets."""
    n = np.diff(offsets)
    m = np.maximum(n - k + 1, 0)
    out = np.concatenate(([0], np.cumsum(m)))
    if len(words) < k:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    h = np.zeros(len(words) - k + 1, U64)
    for j in range(k):
        h = h * U64(0xD1342543DE82EF95) + words[j : j + len(h)]
    keep = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], m)
    return mix(h[keep]), out
