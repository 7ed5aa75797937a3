"""Full-text search over title, author and body with BM25, phrases and snippets.

A term is a word of the query; a term of several tokens is a phrase inside one column.  All terms must occur, in any
columns.  Statistics cover all stories, removed ones too.

The index is two stored tables: postings (token, id, field, positions) in the order of their tokens, so that a query reads
the row groups of its own tokens only, a frequent token being spread over several files; and one narrow row per story.  A
query never reads a body, but for the snippets of its page.  Only the numbers of stories per term go through the driver.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import ACCENTED, PLAIN, escape_html, tokens
from folioforge.model import Library
from folioforge.operators.listing import filtered, representatives, titled

K1, B, LEAST_IDF, SNIPPET = 1.2, 0.75, 1e-6, 12
FIELDS = ("title", "author", "body_text")


def phrases(query: str) -> list[list[str]]:
    """The token lists of a query's terms; terms without tokens are left out."""
    table = str.maketrans(ACCENTED, PLAIN)
    out = []
    for term in query.split():
        t = re.sub("[̀-ͯ]", "", term.lower().translate(table))
        found = ["".join(g) for g in re.findall(r"((?:[^\W_])+)", t)] if t else []
        found = [x for x in found if any(unicodedata.category(c)[0] in "LN" for c in x)]
        if found:
            out.append(found)
    return out


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokenized(stories: DataFrame) -> DataFrame:
    return stories.select("id", "group_id", "part_index", "title", "author", "status", "body_text", *(tokens(F.col(f)).alias(f"_{f}") for f in FIELDS))


def postings(stories: DataFrame) -> DataFrame:
    """(token, id, field, positions): the inverted index as a table."""
    t = tokenized(stories)
    parts = [t.select("id", F.lit(f).alias("field"), F.posexplode(f"_{f}").alias("position", "token")) for f in FIELDS]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("token", "id", "field").agg(F.sort_array(F.collect_list("position")).alias("positions"))


SHOWN = ("id", "group_id", "part_index", "title", "author", "status")


@dataclass(frozen=True)
class Index:
    """``postings``(token, id, field, positions) and ``entries``(the shown columns and ``length``, a story's tokens)."""

    postings: DataFrame
    entries: DataFrame

    @staticmethod
    def of(stories: DataFrame) -> Index:
        length = sum((F.size(tokens(F.col(f))) for f in FIELDS), F.lit(0))
        return Index(postings(stories), stories.select(*SHOWN, length.alias("length")))

    def stored(self, folder: str) -> Index:
        """Writes the index; tokens lie in order, the stories of a frequent one over several files."""
        self.postings.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{folder}/postings")
        self.entries.write.mode("overwrite").parquet(f"{folder}/entries")
        return Index.opened(self.entries.sparkSession, folder)

    @staticmethod
    def opened(spark: SparkSession, folder: str) -> Index:
        return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/entries"))

    def updated(self, changed: DataFrame, gone: DataFrame | None = None) -> Index:
        """The index after stories were added or changed, and those with an id in ``gone`` deleted."""
        new = Index.of(changed)
        out = changed.select("id") if gone is None else changed.select("id").unionByName(gone.select("id"))
        keep = lambda df: df.join(out, "id", "left_anti").select(*df.columns)
        return Index(keep(self.postings).unionByName(new.postings), keep(self.entries).unionByName(new.entries))


def _less(k: int):
    return lambda x: x - k


def hits(index: Index, phrase: list[str]) -> DataFrame:
    """(id, tf): how often a phrase stands in each story that holds it."""
    first, *rest = (index.postings.where(F.col("token") == t).select("id", "field", F.col("positions").alias(f"p{k}")) for k, t in enumerate(phrase))
    for other in rest:
        first = first.join(other, ["id", "field"])
    follows = [F.transform(f"p{k}", _less(k)) for k in range(1, len(phrase))]
    places = reduce(F.array_intersect, follows, F.col("p0"))
    return first.select("id", F.size(places).alias("n")).groupBy("id").agg(F.sum("n").alias("tf")).where("tf > 0")


def scored(index: Index, query: str) -> DataFrame:
    """All stories that match, with ``r``: minus the BM25 score, lower is better."""
    terms = phrases(query)
    if not terms:
        return index.entries.where("false").withColumn("r", F.lit(0.0))
    found = [hits(index, phrase) for phrase in terms]
    counted = [h.agg(F.lit(k).alias("k"), F.count("*").alias("n")) for k, h in enumerate(found)]
    sizes = {r.k: r.n for r in reduce(DataFrame.unionByName, counted).collect()}
    whole = index.entries.agg(F.count("*").alias("n"), F.avg("length").alias("d")).first()
    rows, score = None, F.lit(0.0)
    for k, h in enumerate(found):
        idf = math.log((whole.n - sizes[k] + 0.5) / (sizes[k] + 0.5)) if whole.n else 0.0
        tf = F.col(f"tf{k}")
        score = score + (idf if idf > 0 else LEAST_IDF) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("length") / (whole.d or 1.0)))
        h = h.withColumnRenamed("tf", f"tf{k}")
        rows = h if rows is None else rows.join(h, "id")
    return rows.join(index.entries, "id").withColumn("r", -score)


def snippet(body: Column, terms: list[list[str]], size: int = SNIPPET) -> Column:
    """The first window of ``size`` words with the most words that hit, escaped, hits in mark tags, … at cut sides."""
    wanted = F.array(*(F.lit(t) for p in terms for t in p))

    def windowed(x: Column) -> Column:
        words, hit = x["words"], x["hit"]
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
        total = F.transform(starts, lambda i: F.aggregate(F.slice(hit, i + 1, F.lit(size)), F.lit(0), lambda s, y: s + y))

        def shown(y: Column) -> Column:
            at, words, hit = y["at"], y["words"], y["hit"]
            marked = F.zip_with(F.slice(words, at, F.lit(size)), F.slice(hit, at, F.lit(size)), lambda w, h: F.when(h == 1, F.concat(F.lit("<mark>"), escape_html(w), F.lit("</mark>"))).otherwise(escape_html(w)))
            text = F.concat(F.when(at > 1, "…").otherwise(""), F.array_join(marked, " "), F.when(at + size <= F.size(words), "…").otherwise(""))
            return F.when(F.size(words) == 0, "").otherwise(text)

        at = bound(total, lambda t: F.array_position(t, F.array_max(t)).cast("int"))
        return bound(F.struct(at.alias("at"), words.alias("words"), hit.alias("hit")), shown)

    words = F.filter(F.split(F.coalesce(body, F.lit("")), r"\s+"), lambda w: w != "")
    with_hits = bound(words, lambda ws: F.struct(ws.alias("words"), F.transform(ws, lambda w: F.arrays_overlap(tokens(w), wanted).cast("int")).alias("hit")))
    return bound(with_hits, windowed)


def parts(library: Library, index: Index, query: str, limit: int = 50, offset: int = 0, with_snippet: bool = True) -> DataFrame:
    """Matching active parts, best first."""
    rows = scored(index, query).where("status = 'active'").orderBy("r", "id")
    rows = (rows.offset(offset) if offset else rows).limit(limit).select("id", "group_id", "title", "author", "r")
    if not with_snippet:
        return rows
    bodies = library.stories.select("id", "body_text").join(F.broadcast(rows.select("id")) if limit <= 10_000 else rows.select("id"), "id", "left_semi")
    return rows.join(bodies, "id").select("id", "group_id", "title", "author", "r", snippet(F.col("body_text"), phrases(query)).alias("snippet")).orderBy("r", "id")


def works(library: Library, index: Index, query: str = "", include: tuple[int, ...] = (), exclude: tuple[int, ...] = (), limit: int = 50, offset: int = 0) -> DataFrame:
    """One row per work: its best part for the query, with tag filters on the whole work; ties by id and shown title."""
    best = F.min(F.struct("r", "id", "part_index", "title", "author")).alias("m")
    rows = scored(index, query).where("status = 'active'").groupBy("group_id").agg(best).select("group_id", "m.*")
    rows = filtered(rows, library, include, exclude)
    counts = representatives(index.entries.where("status = 'active'").select("group_id", "part_index")).select("group_id", "part_count")
    rows = titled(rows.join(counts, "group_id"), index.entries.select("group_id", "part_index", "title")).orderBy("r", "id", "title")
    rows = (rows.offset(offset) if offset else rows).limit(limit)
    return rows.select("id", "group_id", "part_index", "title", "author", "part_count", "r")
