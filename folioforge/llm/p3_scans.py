"""Problem 3: noise in text from scanned pages.

Method: running heads and feet are lines that repeat, up to misread letters, at the edges of pages; page numbers are
lines whose numbers go up from page to page; both go out.  The remaining lines are joined, a word cut at a line end
by what the vocabulary of the corpus says of the joined word.  Misread letters are undone where a rare word turns into a
common one by a usual confusion of the recogniser.

The vocabulary is two tables with the number of stories that hold the words of each hashed cell, counted over all stories and
sent to every task; a word's count is the smaller of its two cells.  The tables grow with the bytes of text, far more than the
different words do, up to 2**MOST_BITS cells of two bytes.  So the second pass is a narrow scan.

What is no noise: line breaks between whole words, verse, headings of the author's own (Chapter 2, 5., § 3), words in
dialect and slips of a typist.  Defined results: null, empty and clean texts come out neither as affected nor repaired;
rows that repeat an id give one row.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import texts_of
from folioforge.llm.textcore import U64, word_hashes

#: Cells of a table: one per so many bytes of text, between the two powers of two.
BYTES_PER_CELL, LEAST_BITS, MOST_BITS, CHUNK = 64, 16, 25, 1 << 16
#: Counts lie in two bytes as logarithms, exact up to a thousand and to one part in 2,900 above.
STEPS = 2048
#: A misread word is rarer than the right one by this factor at least.
TIMES, LEAST = 12, 4
#: Misread letters without digits or signs that a story must show (one more sure kind of noise suffices alone).
CONFUSIONS_NEEDED = 3
#: Confusions by shape alone, which no typist makes.  One suffices in a word that is in no other story.
BY_SHAPE = (("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"))
#: Usual confusions of a recogniser, as read and as printed.
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("n", "u"), ("u", "n"),
    ("u", "ll"), ("ri", "n"), ("n", "ri"), ("m", "in"), ("in", "m"), ("li", "h"), ("h", "li"), ("ii", "u"), ("l", "i"), ("i", "l"), ("nn", "m"), ("tl", "d"),
)
#: Digits and signs read for letters.
SIGNS = (("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "s"), ("8", "b"), ("9", "g"), ("6", "b"), ("6", "g"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("3", "e"), ("4", "a"), ("2", "z"), ("7", "t"))
_SIGN = re.compile(r"[a-zA-Z]\d|\d[a-zA-Z]|[a-zA-Z][!|][a-zA-Z]")
_SIGN_WORD = re.compile(r"(?<![\w!|])(?=[\w!|]*[^\W\d_])(?=[\w!|]*[\d!|])[\w!|]*[\w](?![\w|])")
_ORDINAL = re.compile(r"^(?:\d+(?:st|nd|rd|th|s|d|am|pm|km|m|cm|mm|kg|g|ft|in|lb|oz|x|p)|[a-z]\d+|\d+[a-z]|[ivxlc]+)$", re.I)
_CUT = re.compile(r"([^\W\d_]+)([-¬­‐])[ \t]*\n[ \t]*([^\W\d_]+)")
_LINE_CUT = re.compile(r"[-¬\u00ad‐][ \t]*\n")
_NUMBER_LINE = re.compile(r"^\W*(?:page|pg\.?|p\.)?\W*([0-9OolISB]{1,4})\W*$", re.I)
_NUMBER_OF = re.compile(r"^\W*(page|pg\.?|p\.)?\W*([0-9OolISB]{1,4})(?:\W*\b[o0]f\b\W*|\s*/\s*)([0-9OolISB]{1,4})\W*$", re.I)
_DIGITS = str.maketrans("OoLlIiSsBb", "0011115588")
_HEAD_NUMBER = re.compile(r"^(?:(?P<a>\d{1,4})\W+(?P<x>\D.*?)|(?P<y>\D.*?)\W+(?P<b>\d{1,4}))\W*$")
_HEADING = re.compile(r"^\W*(?:(?:chapter|part|book|section|canto|act|scene|§)\W*\w+\W*|\d+\.|[ivxlc]+\.?)$", re.I)


def cells_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A word's places in the two tables."""
    size = (1 << bits) - 1
    return (h >> U64(64 - bits)).astype(np.int64), ((h >> U64(20)).astype(np.int64) & size) + size + 1


def coded(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(STEPS * np.log2(1.0 + counts)), 65535).astype(np.uint16)


def looked_up(cells: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = cells_of(h, len(cells).bit_length() - 2)
    return np.rint(np.exp2(np.minimum(cells[a], cells[b]) / STEPS) - 1).astype(np.int64)


def counted(texts: list, bits: int, total: np.ndarray) -> None:
    """Adds to ``total`` how many of the texts hold the words of each cell."""
    h, at = word_hashes(texts)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at)) << (bits + 1)
    for cell in cells_of(h, bits):
        place, many = np.unique(np.unique(doc | cell) & ((2 << bits) - 1), return_counts=True)
        total[place] += many.astype(total.dtype)


def vocabulary(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(coded number of texts by hashed cell of the word, number of texts)."""
    column = texts.columns[0]
    size = texts.agg(F.sum(F.octet_length(column)).alias("s"), F.count(column).alias("n")).first()
    bits = min(max(math.ceil(math.log2((size.s or 0) / BYTES_PER_CELL + 1)), LEAST_BITS), MOST_BITS)

    def count(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(2 << bits, np.uint32)
        for batch in batches:
            counted(texts_of(batch, 0), bits, total)
        for c in range(0, len(total), CHUNK):
            part = total[c : c + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["c", "v"])

    def add(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, v in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(zlib.decompress(v), np.uint32).astype(np.int64)
        for c, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([zlib.compress(coded(v).tobytes(), 1)], pa.binary())], names=["c", "v"])

    cells, kind = np.zeros(2 << bits, np.uint16), "c bigint, v binary"
    for row in texts.mapInArrow(count, kind).repartition("c").mapInArrow(add, kind).collect():
        cells[row.c : row.c + CHUNK] = np.frombuffer(zlib.decompress(row.v), np.uint16)
    return cells, size.n


def loosened(line: str) -> str:
    """A line as it is compared with others: letters that are misread for each other made one."""
    t = re.sub(r"[^\w]+", " ", line.lower()).strip()
    return t.translate(str.maketrans("015896|!", "olsbgblh".replace("h", "l"))).replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("i", "l").replace("c", "e")


def page_number(line: str) -> int | None:
    """The number of a line that holds nothing but a page number: "12", "Page 12", "Page 12 of 40", "12/40"."""
    if m := _NUMBER_LINE.match(line):
        return int(m[1].translate(_DIGITS)) if any(c.isdigit() for c in m[1]) else None
    if (m := _NUMBER_OF.match(line)) and all(any(c.isdigit() for c in x) for x in (m[2], m[3])):
        number, last = int(m[2].translate(_DIGITS)), int(m[3].translate(_DIGITS))
        return number if m[1] or number <= last else None
    return None


class Page:
    """Findings in one text."""

    def __init__(self):
        self.cuts = self.furniture = self.signs = self.confusions = self.shapes = 0
        self.drop: set[int] = set()

    @property
    def affected(self) -> bool:
        return bool(self.cuts or self.furniture or self.signs or self.shapes or self.confusions >= CONFUSIONS_NEEDED)


class Scans:
    """Finds and repairs the noise of scanned pages, given the vocabulary."""

    def __init__(self, cells: np.ndarray, docs: int):
        self.cells, self.docs = cells, docs
        self.known: dict[str, str | None] = {}
        self.frequency: dict[str, int] = {}

    def df(self, words: list[str]) -> list[int]:
        """In how many texts the words occur; a word of several parts counts by its rarest."""
        h, at = word_hashes(words)
        n = looked_up(self.cells, h)
        return [int(n[at[i] : at[i + 1]].min()) if at[i + 1] > at[i] else 0 for i in range(len(words))]

    def one(self, word: str) -> int:
        n = self.frequency.get(word)
        if n is None:
            n = self.frequency[word] = self.df([word])[0]
        return n

    def printed(self, word: str, own: int) -> str | None:
        """The common word that a rare one was misread from, if any (one confusion of letters; signs are free)."""
        if word in self.known:
            return self.known[word]
        options = {word}
        for a, b in SIGNS:
            if a in word:
                options |= {o.replace(a, b) for o in options} | {o.replace(a, b, 1) for o in options}
        first = {o for o in options if not re.search(r"[\d!|]", o)}
        signs = first != {word}
        step = set(first) if signs else set()
        for o in first:
            for a, b in CONFUSIONS:
                k = o.find(a)
                while k >= 0:
                    step.add(o[:k] + b + o[k + len(a) :])
                    k = o.find(a, k + 1)
        step.discard(word)
        best = None
        if step:
            names = sorted(step)
            counts = self.df(names)
            n, name = max(zip(counts, names, strict=True))
            if n >= LEAST and n >= TIMES * max(1, own):
                best = name
        if len(self.known) > 1 << 18:
            self.known.clear()
        self.known[word] = best
        return best

    # -- page furniture -------------------------------------------------------------------------------

    def furniture(self, lines: list[str], title: str, author: str) -> set[int]:
        """Indexes of lines that are running heads, feet or page numbers."""
        filled = [i for i, x in enumerate(lines) if x.strip()]
        if len(filled) < 3:
            return set()
        place = {i: k for k, i in enumerate(filled)}
        numbers: list[tuple[int, int, str]] = []  # line, number, text beside it
        for i in filled:
            x = lines[i].strip(" \t\x0c")
            if len(x) > 80 or _HEADING.match(x):
                continue
            if (number := page_number(x)) is not None:
                numbers.append((i, number, ""))
            elif not _NUMBER_LINE.match(x) and (m := _HEAD_NUMBER.match(x)) and not re.search(r"[.!?:;,]\s*$", m["x"] or m["y"] or "."):
                beside = m["x"] or m["y"]
                if len(beside) <= 60 and self.headlike(beside, title, author):
                    numbers.append((i, int(m["a"] or m["b"]), beside))
        out: set[int] = set()
        # numbers that go up from page to page
        chain = [k for k in range(len(numbers)) if any(0 < (numbers[j][1] - numbers[k][1]) * (1 if j > k else -1) <= 2 * abs(j - k) for j in (k - 1, k + 1) if 0 <= j < len(numbers))]
        sure = {numbers[k][0] for k in chain}
        for i, _, beside in numbers:
            inner = place[i] + 2 < len(filled)
            if i in sure or self.interrupts(lines, filled, place[i]) or (inner and (beside or any(self.headlike(lines[j], title, author) for j in self.beside(filled, place[i])))):
                out.add(i)
        # heads beside page numbers or form feeds, and lines repeated up to misread letters inside sentences
        short = [i for i in filled if i not in out and len(lines[i].strip()) <= 60 and not _HEADING.match(lines[i].strip(" \t\x0c")) and not re.search(r"[.!?,;:…”\"]\s*$", lines[i])]
        times = Counter(loosened(lines[i]) for i in short)
        for i in short:
            x = lines[i]
            edge = "\x0c" in x or any(j in out for j in self.beside(filled, place[i]))
            head = self.headlike(x, title, author)
            if (edge and (head or times[loosened(x)] > 1)) or (head and times[loosened(x)] > 1 and self.interrupts(lines, filled, place[i])):
                out.add(i)
        if not sure and len(out) == 1 and "\x0c" not in "".join(lines):
            (i,) = out
            if not self.interrupts(lines, filled, place[i]):
                return set()
        return out

    @staticmethod
    def beside(filled: list[int], k: int) -> list[int]:
        return [filled[j] for j in (k - 1, k + 1) if 0 <= j < len(filled)]

    @staticmethod
    def headlike(line: str, title: str, author: str) -> bool:
        """Set in capitals, or the title or author up to misread letters."""
        x = line.strip(" \t\x0c")
        letters = [c for c in x if c.isalpha()]
        if len(letters) < 3 or len(x) > 60:
            return False
        if sum(c.isupper() for c in letters) >= 0.75 * len(letters) and not re.search(r"[.!?,;:]$", x):
            return True
        own = loosened(x)
        return len(own) > 3 and own in (loosened(title), loosened(author))

    def interrupts(self, lines: list[str], filled: list[int], k: int) -> bool:
        """Does the line stand inside a sentence?"""
        def passed(j: int) -> bool:
            x = lines[filled[j]].strip(" \t\x0c")
            return self.headlike(x, "", "") or bool(_NUMBER_LINE.match(x)) or page_number(x) is not None

        a, b = k - 1, k + 1
        while a >= 0 and passed(a):
            a -= 1
        while b < len(filled) and passed(b):
            b += 1
        if a < 0 or b >= len(filled):
            return False
        before, after = lines[filled[a]].rstrip(), lines[filled[b]].lstrip(" \t\x0c")
        return bool(before and after and not re.search(r"[.!?…:”\"’')\]]$", before) and (after[0].islower() or before[-1] in "-¬,"))

    # -- one text -------------------------------------------------------------------------------------

    def joined(self, a: str, mark: str, b: str) -> bool:
        """Is a word cut at a line end one word?"""
        if mark in "¬­":
            return True
        if not b[0].islower():
            return False
        whole, parts = self.one((a + b).lower()), self.one(a.lower() + "-" + b.lower())
        first, second = self.one(a.lower()), self.one(b.lower())
        if whole:
            return True
        # a misread or rare word: one of the halves is no word of its own
        return min(first, second) * 200 < max(1, self.docs) and parts * 200 < max(1, self.docs) and not (first * 500 > self.docs and second * 500 > self.docs)

    def look(self, text: str, title: str, author: str, words: list[tuple[str, int]]) -> tuple[Page, dict[str, str]]:
        """(findings, misread words by what was printed); ``words``: rare words with the number of their texts."""
        page, fixes = Page(), {}
        cuts = list(_CUT.finditer(text)) if _LINE_CUT.search(text) else []
        for m in cuts:
            page.cuts += self.joined(m[1], m[2], m[3])
        if "\n" in text or "\x0c" in text:
            lines = text.split("\n")
            page.drop = self.furniture(lines, title, author)
            page.furniture = len(page.drop) + text.count("\x0c")
        for m in _SIGN_WORD.finditer(text) if _SIGN.search(text) else ():
            w = m[0].lower()
            if w.rstrip("!") != w and not re.search(r"[\d!|]", w.rstrip("!")):
                continue
            w = w.rstrip("!")
            if _ORDINAL.match(w) or len(w) > 24 or len(w) < 2:
                continue
            right = self.printed(w, 0)
            if right and sum(c.isalpha() for c in w) * 2 >= len(w):
                fixes[w] = right
                page.signs += 1
        broken = {p.lower() for m in cuts for p in (m[1], m[3])}
        for w, own in words:
            if w not in broken and w.isascii() and 2 < len(w) <= 24 and w.isalpha():
                right = self.printed(w, own)
                if right:
                    fixes[w] = right
                    page.confusions += 1
                    page.shapes += own <= 1 and self.by_shape(text, w, right)
        return page, fixes

    @staticmethod
    def by_shape(text: str, word: str, right: str) -> bool:
        """Was the word misread by shape alone?  Beside a character that can't be seen it is a piece of a disguised word."""
        if not any(word[: m.start()] + b + word[m.end() :] == right for a, b in BY_SHAPE for m in re.finditer(a, word)):
            return False
        for m in re.finditer(r"(?<![^\W_])" + word + r"(?![^\W_])", text, re.I):
            if any(unicodedata.category(c) in ("Cf", "Mn", "Cc") and c not in "\n\r\t\x0c" for c in text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]):
                return False
        return True

    def repair(self, text: str, page: Page, fixes: dict[str, str]) -> str:
        lines = text.split("\n")
        kept: list[str] = []
        bridging = False  # furniture taken out of a sentence: no paragraph ends there
        for i, x in enumerate(lines):
            if i in page.drop:
                bridging = True
                continue
            x = x.replace("\x0c", "").strip()
            if not x and bridging and (not kept or not kept[-1] or not re.search(r"[.!?…:”\"’')\]]$", kept[-1])):
                continue
            if x:
                if bridging and kept and not kept[-1] and len(kept) > 1 and not re.search(r"[.!?…:”\"’')\]]$", kept[-2]):
                    kept.pop()
                bridging = False
            kept.append(x)
        t = "\n".join(kept)
        t = _CUT.sub(lambda m: m[1] + m[3] if self.joined(m[1], m[2], m[3]) else m[1] + m[2] + m[3], t)
        t = "\n\n".join(re.sub(r"\s*\n\s*", " ", p).strip() for p in re.split(r"\n{2,}", t) if p.strip())
        if fixes:

            def fix(m: re.Match) -> str:
                new = fixes.get(m[0].lower())
                if new is None:
                    return m[0]
                return new.upper() if m[0].isupper() and len(m[0]) > 2 else new[0].upper() + new[1:] if m[0][0].isupper() else new

            t = re.sub("(?<!\\w)(?:" + "|".join(re.escape(w) for w in sorted(fixes, key=len, reverse=True)) + ")(?!\\w)", fix, t, flags=re.I)
        return t

    def batch(self, texts: list, titles: list, authors: list) -> Iterator[tuple[int, Page, dict[str, str]]]:
        """(position, findings, fixes) of every affected text."""
        spans: list = []
        h, at = word_hashes(texts, spans)
        if not len(h):
            return
        start, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
        n = looked_up(self.cells, h)
        rare = n * TIMES <= max(self.docs, LEAST * TIMES)
        for i, t in enumerate(texts):
            if t:
                own = np.flatnonzero(rare[at[i] : at[i + 1]]) + at[i]
                words = {t[start[k] : stop[k]].lower(): int(n[k]) for k in own.tolist()}
                page, fixes = self.look(t, titles[i] or "", authors[i] or "", list(words.items()))
                if page.affected:
                    yield i, page, fixes


def _scan(stories: DataFrame, schema: str, build) -> DataFrame:
    cells, docs = vocabulary(stories.select("body_text").where("body_text is not null"))
    table = stories.sparkSession.sparkContext.broadcast((cells, docs))  # at most 2 * 2**MOST_BITS counts

    def run(batches: Iterator[pa.RecordBatch]):
        scans = Scans(*table.value)
        for batch in batches:
            texts = texts_of(batch, 1)
            found = list(scans.batch(texts, texts_of(batch, 2), texts_of(batch, 3)))
            if found:
                yield build(scans, batch, texts, found)

    return stories.select("id", "body_text", "title", "author").where("body_text is not null").mapInArrow(run, schema)


def affected(stories: DataFrame) -> DataFrame:
    """(id) of the stories whose body carries noise from scanning."""
    return _scan(stories, "id string", lambda scans, batch, texts, found: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _, _ in found]))], names=["id"])).distinct()


def repaired(stories: DataFrame) -> DataFrame:
    """(id, body_text) of these stories as continuous paragraphs."""

    def build(scans, batch, texts, found):
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _, _ in found])), pa.array([scans.repair(texts[i], page, fixes) for i, page, fixes in found], pa.string())], names=["id", "body_text"])

    return _scan(stories, "id string, body_text string", build).groupBy("id").agg(F.max("body_text").alias("body_text"))
