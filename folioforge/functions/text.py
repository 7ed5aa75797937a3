"""Column builders for titles, folding, matching, markup and other text."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and their plain letters.
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöōőŕřśšşťţùúûüūůűųýÿžźżğ"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiinnnooooooorrsssttuuuuuuuuyyzzzg"
TOKEN = r"[\p{L}\p{N}]+"
#: Any blank, Unicode ones too.
BLANK = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
ARTICLES = ("a", "an", "the")


def ascii_lower(c: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def contains(c: Column, q: str) -> Column:
    """``LIKE %q%`` with % and _ of the user as wild cards and ASCII case ignored."""
    folded = "".join(x.lower() if x in string.ascii_uppercase else x for x in q).replace("\\", "\\\\")
    return ascii_lower(c).like(f"%{folded}%")


def blank_as_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def effective_title(own: Column, first_part: Column) -> Column:
    """The part's title, else the title of part 0, else a stand-in."""
    return F.coalesce(blank_as_null(own), blank_as_null(first_part), F.lit("(untitled)"))


def sort_key(title: Column) -> Column:
    """The title without one leading article; the case of the rest counts."""
    low, out = ascii_lower(title), title
    for a in reversed(ARTICLES):
        out = F.when(low.like(f"{a} _%"), F.ltrim(F.substr(title, F.lit(len(a) + 2)))).otherwise(out)
    return out


def folded(c: Column) -> Column:
    """Lower case without accents, as tokens are compared."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), "[\\u0300-\\u036f]", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(folded(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def paragraphs(c: Column) -> Column:
    """Paragraphs with their blanks collapsed, empty ones left out, an empty line between."""
    parts = F.transform(F.split(c, rf"\n{BLANK}*\n"), lambda p: F.trim(F.regexp_replace(p, f"{BLANK}+", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def normalized_tags(c: Column) -> Column:
    """Tag texts trimmed and lower-cased, what follows the last colon, blanks and repeats left out, order kept."""
    one = F.transform(c, lambda t: stripped(F.substring_index(F.lower(stripped(t)), ":", -1)))
    return F.array_distinct(F.filter(one, lambda t: t.isNotNull() & (t != "")))


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), stripped), lambda t: t != "")


def duration(seconds: Column) -> Column:
    """``~1d 1h``, ``~1h 1m``, ``~1m`` or ``<1m``."""
    s = F.greatest(F.floor(seconds).cast("bigint"), F.lit(0))
    d, h, m = F.floor(s / 86400).cast("bigint"), F.floor(s % 86400 / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint")
    return (
        F.when(d > 0, F.concat(F.lit("~"), d, F.lit("d "), h, F.lit("h")))
        .when(h > 0, F.concat(F.lit("~"), h, F.lit("h "), m, F.lit("m")))
        .when(m > 0, F.concat(F.lit("~"), m, F.lit("m")))
        .otherwise("<1m")
    )


#: Context sizes that a model server is asked for, tokens kept free, characters per token, prompt reserve.
CONTEXTS = (4096, 8192, 16384, 32768, 65536, 131072)
RESERVE, CHARS_PER_TOKEN, PROMPT_CHARS = 512, 4, 4000


def context_size(length: Column, cap: Column) -> Column:
    """The smallest usable context that holds the text and the reserve, else the largest usable one."""
    usable = F.filter(F.array(*map(F.lit, CONTEXTS)), lambda x: x <= cap)
    fitting = F.filter(usable, lambda x: x >= F.floor(length / CHARS_PER_TOKEN) + RESERVE)
    return F.coalesce(F.array_min(fitting), F.array_max(usable), F.lit(CONTEXTS[0]))


def body_limit(context: Column) -> Column:
    return (context - RESERVE) * CHARS_PER_TOKEN - PROMPT_CHARS


def effective_context(hardware_cap: Column, model_max: Column) -> Column:
    return F.greatest(F.least(hardware_cap, F.lit(CONTEXTS[-1]), model_max), F.lit(CONTEXTS[0]))


def rendered(template: Column, title: Column, author: Column, body: Column) -> Column:
    """The prompt with its places filled one after another."""
    t = F.replace(template, F.lit("{title}"), F.coalesce(F.nullif(title, F.lit("")), F.lit("(untitled)")))
    t = F.replace(t, F.lit("{author}"), F.coalesce(F.nullif(author, F.lit("")), F.lit("(unknown)")))
    return F.replace(t, F.lit("{body_text}"), body)


def truncated(body: Column, most: int, mark: str = "\n[... truncated ...]") -> Column:
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit(mark))).otherwise(body)


def chunk_paragraphs(body: Column, most: int) -> Column:
    """Paragraphs packed greedily into pieces of at most ``most`` characters; longer paragraphs are cut hard."""
    sliced = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        done, current = acc["done"], acc["open"]
        closed = F.when(current.isNull(), done).otherwise(F.concat(done, F.array(current)))
        return (
            F.when(F.length(p) > most, F.struct(F.concat(closed, sliced(p)).alias("done"), F.lit(None).cast("string").alias("open")))
            .when(current.isNotNull() & (F.length(current) + 2 + F.length(p) <= most), F.struct(done.alias("done"), F.concat(current, F.lit("\n\n"), p).alias("open")))
            .otherwise(F.struct(closed.alias("done"), p.alias("open")))
        )

    finish = lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
    return F.when(F.length(body) <= most, F.array(body)).otherwise(F.aggregate(F.split(body, "\n\n"), empty, step, finish))
