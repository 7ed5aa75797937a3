"""Tags and site tags with their counts, clouds, name search, and other small lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import contains
from folioforge.model import Library


def _page(df: DataFrame, order: list, limit: int | None, offset: int) -> DataFrame:
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def tag_counts(library: Library, q: str = "", limit: int | None = None, offset: int = 0) -> DataFrame:
    """(id, name, story_count): links per tag, parts of removed stories included; tags without links count 0."""
    n = library.links.groupBy("tag_id").agg(F.count("*").alias("n"))
    tags = library.tags.where(contains(F.col("name"), q)) if q else library.tags
    rows = tags.join(n, F.col("id") == F.col("tag_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("story_count"))
    return _page(rows, [F.desc("story_count"), "name"], limit, offset)


def site_tag_counts(library: Library, q: str = "", limit: int | None = None, offset: int = 0) -> DataFrame:
    n = library.story_site_tags.groupBy("code").agg(F.countDistinct("story_id").alias("n"))
    tags = library.site_tags.where(contains(F.col("label"), q)) if q else library.site_tags
    rows = tags.join(n, "code", "left").select("code", "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("story_count"))
    return _page(rows, [F.desc("story_count"), "label"], limit, offset)


def tag_cloud(library: Library, limit: int | None = 40) -> DataFrame:
    """(kind, key, label, story_count): both tag systems in one list, most used first."""
    site = site_tag_counts(library).select(F.lit("site").alias("kind"), F.col("code").alias("key"), "label", "story_count")
    own = tag_counts(library).select(F.lit("tag").alias("kind"), F.col("id").cast("string").alias("key"), F.col("name").alias("label"), "story_count")
    return _page(site.unionByName(own), [F.desc("story_count"), "label", "kind", "key"], limit, 0)


def tag_cloud_size(library: Library) -> DataFrame:
    return library.site_tags.select("code").unionAll(library.tags.select("name")).agg(F.count("*").alias("tags"))


def autocomplete(library: Library, q: str, limit: int = 20) -> DataFrame:
    return tag_counts(library, q, limit)


def count_matching(df: DataFrame, column: str, q: str = "") -> DataFrame:
    return (df.where(contains(F.col(column), q)) if q else df).agg(F.count("*").alias("n"))


def tags_of(library: Library, story_id: str) -> DataFrame:
    """(id, name, source, confidence) of a story's tags, whatever its status."""
    links = library.links.where(F.col("story_id") == story_id).select(F.col("tag_id").alias("id"), "source", "confidence")
    return library.tags.select("id", "name").join(links, "id").orderBy("name")


def site_tags_of(library: Library, story_id: str) -> DataFrame:
    codes = library.story_site_tags.where(F.col("story_id") == story_id).select("code").distinct()
    return library.site_tags.join(codes, "code").select("code", "label").orderBy("label", "code")


def prompts(library: Library, q: str = "", limit: int = 20, offset: int = 0) -> DataFrame:
    rows = library.prompts.where(contains(F.col("name"), q)) if q else library.prompts
    return _page(rows.select("id", "name", "based_on_id", "created_at"), [F.desc("created_at"), "id"], limit, offset)


def prompt_lineage(library: Library) -> DataFrame:
    """(id, name, parent_id, parent_name) of prompts made from another."""
    p = library.prompts
    return p.alias("a").join(p.alias("b"), F.expr("a.based_on_id = b.id")).select(F.expr("a.id id"), F.expr("a.name name"), F.expr("b.id parent_id"), F.expr("b.name parent_name"))


def equal_to(df: DataFrame, **values) -> DataFrame:
    """Rows that equal every given value; None asks for nothing."""
    for column, value in values.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def has_candidates(library: Library, version: str) -> DataFrame:
    """(id) of the active stories with a proposal of this prompt version."""
    c = library.tag_candidates.where(F.col("prompt_version") == version).select(F.col("story_id").alias("id"))
    return library.active.select("id").join(c, "id", "left_semi")


def pending_candidates(library: Library) -> DataFrame:
    return library.tag_candidates.where("status = 'candidate'").select("id", "story_id", "tag_text")


def text_histogram(library: Library) -> DataFrame:
    """(tag_text, uses, first_id) of the pending proposals."""
    return pending_candidates(library).groupBy("tag_text").agg(F.count("*").alias("uses"), F.min("id").alias("first_id"))


def in_scope(library: Library, scope: str | None, exclude_job: int | None = None) -> DataFrame:
    """(id, title) of active stories in a job's scope: ``untagged`` means without any link; every other word means all.

    Stories that already have a proposal of ``exclude_job`` are left out.
    """
    rows = library.active.select("id", "title")
    if scope == "untagged":
        rows = rows.join(library.story_tags.select(F.col("story_id").alias("id")), "id", "left_anti")
    if exclude_job is not None:
        rows = rows.join(library.tag_candidates.where(F.col("job_id") == exclude_job).select(F.col("story_id").alias("id")), "id", "left_anti")
    return rows


def canonical_of(members: DataFrame, cluster: str, text: str, uses: Column) -> DataFrame:
    """(cluster, name): the most used member, the shortest and then the first of equals."""
    return members.groupBy(cluster).agg(F.min(F.struct((-uses).alias("u"), F.length(text).alias("n"), F.col(text).alias("t"))).alias("m")).select(cluster, F.col("m.t").alias("name"))
