"""Problem 6: one consistent form for texts that look alike.

Method: DuckDB inside Arrow partitions.  Every Arrow batch becomes a relation of an embedded, single-threaded
DuckDB; its SQL composes with ``nfc_normalize``, maps compatibility letters, blanks and look-alikes with
``translate`` and ``regexp_replace`` and takes invisible characters out.  The scan is narrow: no shuffle before the
final de-duplication of ids.

What changes: characters that stand in for an ordinary letter, digit, accented letter or blank (full-width,
mathematical and circled letters, ligatures, decomposed accents, special blanks, look-alike letters inside a word
of another script or as a word between Latin words) and characters that can't be seen.  What stays: ordinary
typography, composed letters, emoji with their joiners, words wholly in another script, runs of plain blanks.

Defined results: null stays null and empty stays empty; the mapping is idempotent; rows that repeat an id give one row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters without width (soft hyphen, joiners, marks of direction, fillers, tags).
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{206A}-\x{206F}\x{3164}\x{FEFF}\x{FFA0}\x{E0001}\x{E0020}-\x{E007F}"
#: Blanks other than the plain one.
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Cyrillic, Greek and other letters and the Latin letters they look like.
ALIKE_FROM = "аеорсухіјѕһԁԛԝӏкАВЕКМНОРСТУХІЈЅҮԌԚԜӀ" + "αεικνορτυχγηωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "ɑɡօոսհցԼՕՍ"
ALIKE_TO = "aeopcyxijshdqwlkABEKMHOPCTYXIJSYGQWI" + "aeikvoptuxynwABEZHIKMNOPTYX" + "agonuhgLOU"
#: Latin letters inside a Cyrillic word and the letters they look like.
BACK_FROM = "aeopcyxijsABEKMHOPCTYXIJS"
BACK_TO = "аеорсухіјѕАВЕКМНОРСТУХІЈЅ"
_KEPT = "\ufdd1"  # a noncharacter, holds the place of a joiner that stays
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}\x{3001}\x{3002}\x{300D}\x{300F}"


@lru_cache(1)
def compatibility() -> tuple[str, str, dict[str, str]]:
    """(from, to) of single characters and the ones that stand for several, from Unicode's own data."""
    ranges = ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0x1D400, 0x1D7FF), (0x24B6, 0x24E9), (0x2102, 0x2115), (0x2117, 0x211D), (0x2124, 0x213F), (0x2145, 0x2149), (0x2160, 0x217F), (0xFB00, 0xFB06))
    one: dict[str, str] = {}
    many: dict[str, str] = {}
    for a, b in ranges:
        for c in map(chr, range(a, b + 1)):
            k = unicodedata.normalize("NFKC", c)
            if k != c and all(x.isalnum() for x in k):
                (one if len(k) == 1 else many)[c] = k
    return "".join(one), "".join(one.values()), many


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(1)
def statement() -> str:
    """The embedded SQL: (i, x) in, (i, y) out for the texts that change."""
    source, target, many = compatibility()
    suspicious = f"[{INVISIBLE}{BLANKS}{source}{''.join(many)}{ALIKE_FROM}\\x{{0300}}-\\x{{036F}}\\x{{1100}}-\\x{{11FF}}\\x{{212A}}\\x{{212B}}\\x{{2126}}\\x{{F900}}-\\x{{FAFF}}\\x{{FE00}}-\\x{{FE0F}}\\x{{0653}}-\\x{{0655}}\\x{{093C}}]"
    protect = (
        # joiners inside emoji and inside the scripts that use them; the blank of ideographs
        f"regexp_replace(regexp_replace(x, '([\\p{{So}}\\p{{Sk}}\\x{{FE0F}}\\x{{1F3FB}}-\\x{{1F3FF}}])\\x{{200D}}', '\\1{_KEPT}', 'g'), "
        f"'([\\x{{0600}}-\\x{{06FF}}\\x{{0900}}-\\x{{0DFF}}])\\x{{200D}}', '\\1{_KEPT}', 'g')"
    )
    spaced = f"translate({{0}}, {_quoted(BLANKS)}, {_quoted(' ' * len(BLANKS))})"
    removed = f"regexp_replace(regexp_replace({{0}}, '([\\x{{0600}}-\\x{{06FF}}\\x{{0900}}-\\x{{0DFF}}]\\x{{200C}})|[{INVISIBLE}]', '\\1', 'g'), '(\\p{{L}})[\\x{{FE00}}-\\x{{FE0F}}]+', '\\1', 'g')"
    ideographic = f"regexp_replace({{0}}, '([{_CJK}])\\x{{3000}}', '\\1\ufdd2', 'g')"
    step = removed.replace("{0}", protect)
    step = spaced.replace("{0}", ideographic.replace("{0}", step))
    step = f"translate({step}, {_quoted(source)}, {_quoted(target)})"
    for c, k in many.items():
        step = f"replace({step}, {_quoted(c)}, {_quoted(k)})"
    step = f"nfc_normalize(replace(replace({step}, '{_KEPT}', '\u200d'), '\ufdd2', '\u3000'))"
    # Words are told apart by script: [Latin], [alike letters only], [another script]
    alike = f"[{ALIKE_FROM}]"
    latin, mixed, other = r"[\p{Latin}]", f"regexp_matches(w, '[\\p{{Latin}}]') and regexp_matches(w, '{alike}')", f"regexp_matches(w, '[^\\p{{Latin}}{ALIKE_FROM}]')"
    only_back = f"not regexp_matches(w, '[^\\P{{Latin}}{BACK_FROM}]')"
    to_latin = f"translate({{0}}, {_quoted(ALIKE_FROM)}, {_quoted(ALIKE_TO)})"
    return f"""
with hit as materialized (select i, x, {step} as y from batch where regexp_matches(x, {_quoted(suspicious)})),
letters as (select i, x, y, regexp_matches(y, '{alike}') and regexp_matches(y, '{latin}') as twofold from hit),
words as (
  select i, x, regexp_extract_all(y, '\\pL+|\\PL+') as ws from letters where twofold
),
fixed as (
  select i, x, ws, list_transform(ws, lambda w: case
    when {mixed} then case when {other} and {only_back} then translate(w, {_quoted(BACK_FROM)}, {_quoted(BACK_TO)}) else {to_latin.replace("{0}", "w")} end
    else w end) as fs from words
),
alone as (
  select i, x, nfc_normalize(array_to_string(list_transform(range(1, len(fs) + 1), lambda k: case
    when regexp_full_match(fs[k], '{alike}+') and (k < 3 or regexp_matches(fs[k - 2], '{latin}')) and (k + 2 > len(fs) or regexp_matches(fs[k + 2], '{latin}'))
    then {to_latin.replace("{0}", "fs[k]")} else fs[k] end), '')) as y from fixed
)
select i, y from alone where x <> y
union all
select i, y from letters where not twofold and x <> y
"""


class Visible:
    def __init__(self):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1})

    def changed(self, texts: pa.Array) -> tuple[list[int], list[str]]:
        """(positions, new texts) of the texts that aren't in the consistent form."""
        batch = pa.table({"i": pa.array(range(len(texts)), pa.int64()), "x": texts})
        self.con.register("batch", batch)
        rows = self.con.execute(statement()).fetchall()
        self.con.unregister("batch")
        return [r[0] for r in rows], [r[1] for r in rows]


@lru_cache(1)
def _worker() -> Visible:
    return Visible()


FIELDS = ("title", "body_text")


def normalized(stories: DataFrame) -> DataFrame:
    """(id, title, body_text) of every story in the consistent form."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns = [batch.column(0)]
            for k in (1, 2):
                texts = batch.column(k).to_pylist()
                for i, y in zip(*_worker().changed(batch.column(k)), strict=True):
                    texts[i] = y
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", *FIELDS])

    return stories.select("id", *FIELDS).mapInArrow(run, "id string, title string, body_text string").dropDuplicates(["id"])


def disguised(stories: DataFrame) -> DataFrame:
    """(id, field) of every title and body that the consistent form changes."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k, field in enumerate(FIELDS, 1):
                at, _ = _worker().changed(batch.column(k))
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([field] * len(at))], names=["id", "field"])

    return stories.select("id", *FIELDS).mapInArrow(run, "id string, field string").distinct()
