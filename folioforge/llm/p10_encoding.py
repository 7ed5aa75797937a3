"""Problem 10: texts decoded with a wrong character encoding.

Method: best-first graph search.  A state is a paragraph; an edge encodes it with one character encoding and
decodes it with another, or unescapes HTML.  States are kept in a heap by their character-plausibility cost
plus a small price per edge, visited states by hash, and the cheapest state reached is the restored paragraph.
A paragraph is searched only if its own cost holds something implausible; where something implausible is left, its lines and
then its words are searched each by itself, so that places read in different encodings, or beside an unrelated odd character, are
found.  A text is affected if the search found a clearly cheaper paragraph, or if it holds replacement characters (what they
stood for is lost).

The cost looks at each non-ASCII character with its two neighbours: controls, symbols inside words, scripts
mixed in a word, capitals after small letters, letter pairs that are lead and continuation bytes.  It uses no
table of the corpus, so it behaves alike at every size; costs of seen triples are remembered per worker.

An ASCII paragraph is searched if it holds character entities, from what they stand for; entities of a text that was
read rightly don't make it affected.

Bounds of the search: MOST_STEPS misreadings in a row; encodings of several bytes only where LEAST_MULTI characters and a
third of the piece aren't ASCII; once a UTF-8 reading leaves nothing implausible, single-byte readings of the same text aren't
tried, as such a reading isn't there by chance.  The number of states isn't limited.

A narrow scan: no shuffle.  Defined results: null and plain ASCII texts without entities are never affected; every affected row comes out
once under its own doc_id, repeated texts included; what can't be restored stays as it is.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.llm.common import texts_of

#: Encodings that UTF-8 was read as, and pairs (read as, was) of other mistakes.
UTF8_AS = ("cp1252", "latin_1", "cp437", "mac_roman", "cp1251", "cp850", "koi8_r", "cp866", "cp1250", "iso8859_2", "iso8859_15", "cp1254", "mac_cyrillic")
READ_AS = (
    ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1252", "cp1251"), ("latin_1", "cp1251"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1252", "koi8_r"), ("latin_1", "koi8_r"),
    ("cp1252", "cp866"), ("latin_1", "cp866"), ("cp1252", "cp1250"), ("cp1252", "iso8859_2"), ("latin_1", "iso8859_2"), ("latin_1", "cp1250"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("latin_1", "mac_roman"), ("latin_1", "cp1252"), ("cp850", "cp437"), ("cp437", "cp850"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"),
    ("cp437", "cp1251"), ("cp437", "cp866"), ("cp866", "koi8_r"), ("koi8_r", "cp866"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"), ("mac_roman", "cp1251"), ("cp1252", "cp1253"), ("latin_1", "cp1253"), ("cp1252", "cp1254"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("cp1253", "cp1252"), ("cp1251", "mac_cyrillic"), ("mac_cyrillic", "cp1251"),
)
MULTI = tuple((a, b) for b in ("euc_jp", "shift_jis", "gb18030", "big5", "euc_kr") for a in ("cp1251", "latin_1", "cp1252", "koi8_r", "iso8859_5", "iso8859_2", "cp437", "mac_roman"))
#: Price of an edge, gain that a restored text must show, cost of one character from which it counts as implausible, and
#: misreadings in a row that are undone.
EDGE, MARGIN, IMPLAUSIBLE, MOST_STEPS = 0.6, 0.8, 0.8, 3
#: Encodings of several bytes are tried on pieces with so many non-ASCII characters, a third of the piece at least.
LEAST_MULTI = 4
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_ONE = re.compile(r"[^\x00-\x7f]")
#: An encoding is tried on a paragraph if it holds this share of the different implausible characters.
SHARE = 0.8
#: Separators of ever smaller pieces of a paragraph, and the share there: any encoding is tried on a word.
_PIECES = ((re.compile(r"(\n)"), SHARE), (re.compile(r"(\s+)"), 0.0))
_PARAGRAPH = re.compile(r"(\n\s*\n)")
_TYPOGRAPHY = frozenset("“”‘’—–…«»„")
_RUSSIAN = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
_WESTERN = frozenset("áàâäãåçéèêëíìîïñóòôöõøúùûüýÿæœßÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØÚÙÛÜÝŸÆŒąćęłńśźżĄĆĘŁŃŚŹŻčďěňřšťůžČĎĚŇŘŠŤŮŽőűŐŰăâîșțşţğıİđĐ")
_CONTINUES = frozenset("¡¿§¶·\u00ad¨¯´¸²³¹ªº¼½¾‚„†‡•‰ˆ˜‹›\u00a0¢£¤¥¦©¬®°±µ")
_AFTER_NUMBER = frozenset("°ºª²³¹½¼¾™®©µ%‰")


@lru_cache(None)
def byte_maps(encoding: str) -> tuple[dict[str, int], list[str]]:
    """(character -> byte, byte -> character), undefined bytes standing for the control of their number."""
    back = []
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        back.append(c if len(c) == 1 else chr(b))
    return {c: b for b, c in reversed(list(enumerate(back)))}, back


@lru_cache(None)
def script(c: str) -> str:
    """A coarse class of a character."""
    o = ord(c)
    if o < 0x80:
        return "L" if c.isalpha() else "N" if c.isdigit() else "B" if c.isspace() else "P"
    if c.isalpha():
        if o < 0x250 or 0x1E00 <= o < 0x1F00:
            return "P" if c in "ªº" else "L"
        name = unicodedata.name(c, "").split(" ")[0]
        return {"CYRILLIC": "C", "GREEK": "G", "LATIN": "I"}.get(name, "O")
    if unicodedata.category(c) in ("Mn", "Mc", "Lm"):
        return "M"
    return "S" if unicodedata.category(c)[0] == "S" else "B" if c.isspace() else "P"


def triple_cost(p: str, c: str, n: str) -> float:
    """The implausibility of c between p and n ("" at an end)."""
    o, kind = ord(c), script(c)
    pk, nk = script(p) if p else "B", script(n) if n else "B"
    letters = "LCGIO"
    if 0x80 <= o < 0xA0 or o == 0xFFFD or 0xE000 <= o < 0xF900:
        return 3.0
    if kind == "L":
        cost = (0.2 if c.isupper() else 0.1) if c in _WESTERN else 0.9
        if c.isupper() and p and p.islower():
            cost += 1.2
        if nk == "S" or (n and (n in _CONTINUES or 0x80 <= ord(n) < 0xA0)):
            cost += 1.2
        if c in "ÂÃÄÅÐÑâã" and n and ord(n) > 0x7F and nk in "PB" and not (p and p in "“‘«„(\"'"):
            cost += 1.0
        if pk in "CGIO" or nk in "CGIO":
            cost += 1.5
        if c.isupper() and n and n in _WESTERN and n.islower():
            cost += 0.5
        return cost + (0.2 if p and p in _WESTERN else 0.0) + (0.3 if p and p in _WESTERN and n and n in _WESTERN else 0.0)
    if kind == "C":
        cost = 0.1 if c in _RUSSIAN else 0.9
        if c.isupper() and pk == "C" and p.islower():
            cost += 1.5
        if c.islower() and pk == "C" and p.isupper() and nk == "C" and n.isupper():
            cost += 1.0
        if c in "РС" and n and (n in "‚„…†‡€‰‹›•™–—“”‘’°±µ¶·№»«¤¦§©¬­®\xa0" or (nk == "C" and n not in _RUSSIAN)):
            cost += 1.0
        if pk in "LGI" or nk in "LGI":
            cost += 1.5
        return cost
    if kind == "G":
        return 2.0 if pk in "LC" or nk in "LC" else 0.3
    if kind == "I":
        return 2.0
    if kind in "OM":
        if 0xFF61 <= o < 0xFFA0:
            return 1.0
        if 0x3131 <= o < 0x3190 and any(x and 0x4E00 <= ord(x) < 0xD7A4 for x in (p, n)):
            return 1.0  # a Korean letter by itself beside syllables or ideographs
        han = 0x3400 <= o < 0xA000 or o >= 0x20000
        return (0.3 if han else 0.1) + (1.5 if pk in "LC" or nk in "LC" else 0.0)
    if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF61:
        return 0.1 if pk not in "LC" and nk not in "LC" else 0.5
    if c in _TYPOGRAPHY:
        if c in "’‘—–…»«":
            return 0.1 + (1.0 if c not in "’…" and pk in "LCGI" and nk in "LCGI" else 0.0)
        if c in "“„" and pk in letters:
            return 1.0 if nk in letters else 0.3
        return 1.0 if c == "”" and nk in letters and pk in letters else 0.1
    if c in "¡¿":
        return 1.5 if pk in letters else 0.1 if nk in letters or not n else 0.4
    if o == 0xA0:
        return 0.5 if pk in letters and nk in letters else 0.2
    if o == 0xAD or unicodedata.category(c) == "Cf":
        return 0.1 if o == 0x200D and (pk == "S" or (p and ord(p) >= 0xFE00)) else 1.0
    if 0x2500 <= o < 0x25A0:
        return 2.0 if pk in letters or nk in letters or (p and 0x2500 <= ord(p) < 0x25A0) else 1.0
    if o >= 0x1F000:
        return 0.1
    if c in "£€$¥":
        return 0.1 if nk == "N" or pk == "N" or (pk == "B" and nk == "B") else 1.2
    if pk in "LCGI" and nk in "LCGI":
        return 1.6
    if c in _AFTER_NUMBER:
        return 0.2 if nk not in letters else 1.0
    if pk in "LCGI" or nk in "LCGI":
        return 1.2
    return 0.4


class Search:
    """The search, with remembered costs of triples and of whole paragraphs' outcomes."""

    def __init__(self):
        self.triple: dict[str, float] = {}

    def cost(self, text: str) -> tuple[float, float]:
        """(cost of all triples, cost of the implausible ones)."""
        total = bad = 0.0
        known = self.triple
        n = len(text)
        for m in _ONE.finditer(text):
            i = m.start()
            key = text[i - 1 : i + 2] if i else "\x00" + text[:2]
            c = known.get(key)
            if c is None:
                if len(known) > 1 << 18:
                    known.clear()
                c = known[key] = triple_cost(text[i - 1] if i else "", text[i], text[i + 1] if i + 1 < n else "")
            total += c
            if c >= IMPLAUSIBLE:
                bad += c
        return total, bad

    def implausible(self, text: str) -> set[str]:
        """The characters whose triples are implausible."""
        return {text[m.start()] for m in _ONE.finditer(text) if self.triple.get(text[m.start() - 1 : m.start() + 2] if m.start() else "\x00" + text[:2], 9.0) >= IMPLAUSIBLE}

    def steps(self, text: str, share: float) -> Iterator[tuple[bool, str]]:
        """(an UTF-8 step?, text) behind every edge that could have made this share of the implausible characters, one at least."""
        bad = self.implausible(text)
        need = max(share * len(bad), min(1, len(bad)))
        fits = {e: sum(c in byte_maps(e)[0] for c in bad) >= need for e in READERS}
        if "&" in text:
            yield False, html.unescape(text)
        for encoding in UTF8_AS:
            if fits[encoding]:
                yield True, _NON_ASCII.sub(utf8_run(encoding), text)
        for read, was in READ_AS:
            if fits[read]:
                yield False, text.translate(char_map(read, was))
        upper = sum(len(m) for m in _NON_ASCII.findall(text))
        if upper >= LEAST_MULTI and 3 * upper > len(text):
            for read, was in MULTI:
                if fits[read]:
                    to_byte, _ = byte_maps(read)
                    codes = [ord(c) if c < "\x80" else to_byte.get(c) for c in text]
                    if None not in codes:
                        try:
                            yield False, bytes(codes).decode(was)
                        except UnicodeDecodeError:
                            pass

    def restore(self, paragraph: str) -> str:
        """The paragraph restored as a whole, or in lines or words where that leaves something implausible and they come cheaper."""
        best = self.search(paragraph)
        left, bad = self.cost(best)
        for separator, share in _PIECES:
            if bad < IMPLAUSIBLE:
                break
            pieces = separator.split(paragraph)
            if len(pieces) > 1 or share < SHARE:
                text = "".join(x if x.isascii() else self.search(x, share) for x in pieces)
                if text not in (best, paragraph) and self.cost(text)[0] < left:
                    best, (left, bad) = text, self.cost(text)
        return best

    def search(self, paragraph: str, share: float = SHARE) -> str:
        """The cheapest text reachable, or the paragraph itself."""
        cost, bad = self.cost(paragraph)
        if bad < IMPLAUSIBLE:
            return paragraph
        heap = [(cost, 0, paragraph)]
        seen = {hash(paragraph)}
        best, done = (cost - MARGIN, paragraph), False
        while heap:
            f, depth, state = heapq.heappop(heap)
            if done and f > best[0] + 4 * EDGE:
                break
            if depth >= MOST_STEPS:
                continue
            plausible = False
            for utf8, text in self.steps(state, share):
                if plausible and not utf8:
                    break  # a whole UTF-8 reading isn't there by chance
                key = hash(text)
                if key in seen:
                    continue
                seen.add(key)
                total, own_bad = self.cost(text)
                g = total + EDGE * (depth + 1)
                if g < best[0]:
                    best, done = (g, text), own_bad < IMPLAUSIBLE
                    plausible |= utf8 and own_bad < IMPLAUSIBLE
                if own_bad >= IMPLAUSIBLE and g < cost + 4 * EDGE:
                    heapq.heappush(heap, (g, depth + 1, text))
        return best[1]

    def text(self, text: str) -> tuple[bool, str]:
        """(affected, restored text)."""
        if text.isascii() and "&" not in text:
            return False, text
        parts = _PARAGRAPH.split(text)
        for i, p in enumerate(parts):
            if not p.isascii():
                parts[i] = self.restore(p)
            elif "&" in p and not (plain := html.unescape(p)).isascii():
                # entities alone are no wrong encoding; what they stand for may be
                found = self.restore(plain)
                parts[i] = found if found != plain else p
        new = "".join(parts)
        return new != text or "�" in text, new


READERS = tuple(dict.fromkeys([*UTF8_AS, *(a for a, _ in READ_AS), *(a for a, _ in MULTI)]))


@lru_cache(None)
def utf8_run(encoding: str):
    """A replacement function: the UTF-8 sequences inside a run of characters read in ``encoding``."""
    to_byte, to_char = byte_maps(encoding)

    def run(m: re.Match) -> str:
        out: list[str] = []
        held = bytearray()

        def flush() -> None:
            i = 0
            while i < len(held):
                b = held[i]
                size = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1
                if size > 1:
                    try:
                        out.append(held[i : i + size].decode())
                        i += size
                        continue
                    except UnicodeDecodeError:
                        pass
                out.append(to_char[b])
                i += 1
            held.clear()

        for c in m[0]:
            b = to_byte.get(c)
            if b is None or b < 0x80:
                flush()
                out.append(c)
            else:
                held.append(b)
        flush()
        return "".join(out)

    return run


@lru_cache(None)
def char_map(read: str, was: str) -> dict[int, str]:
    """Translation of the upper half of ``read`` into the characters that the bytes have in ``was``."""
    _, a = byte_maps(read)
    _, b = byte_maps(was)
    return {ord(a[i]): b[i] for i in range(128, 256) if ord(a[i]) >= 128}


@lru_cache(1)
def _worker() -> Search:
    codecs.lookup("euc_jp")
    return Search()


def restored(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, lost) of the affected rows: the restored text, and whether characters are lost for good."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at, new = [], []
            for i, t in enumerate(texts_of(batch, 1)):
                if t:
                    hit, text = _worker().text(t)
                    if hit:
                        at.append(i)
                        new.append(text)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(new, pa.string()), pa.array(["�" in t for t in new])], names=["doc_id", "text", "lost"])

    return documents.select(id_col, text_col).mapInArrow(run, f"doc_id {documents.schema[id_col].dataType.simpleString()}, text string, lost boolean")


def affected(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents that were decoded with a wrong encoding, wholly or in places."""
    return restored(documents).select("doc_id")
