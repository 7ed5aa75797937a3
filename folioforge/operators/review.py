"""Proposed tags waiting for a review: links whose source is a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.model import Library


def pending(library: Library, job: int | None = None) -> DataFrame:
    """Pending links; each (story, tag) once per job."""
    rows = library.story_tags.where("source = 'model'").select("story_id", "tag_id", "job_id").distinct()
    return rows if job is None else rows.where(F.col("job_id") == job)


def counts(library: Library, job: int | None = None) -> DataFrame:
    """(stories, tags) with something pending."""
    return pending(library, job).agg(F.countDistinct("story_id").alias("stories"), F.countDistinct("tag_id").alias("tags"))


def by_tag(library: Library, job: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """(id, name, pending_count): most pending stories first."""
    n = pending(library, job).groupBy("tag_id").agg(F.countDistinct("story_id").alias("pending_count"))
    rows = library.tags.select("id", "name").join(n, F.col("id") == F.col("tag_id")).select("id", "name", "pending_count").orderBy(F.desc("pending_count"), "name")
    return (rows.offset(offset) if offset else rows).limit(limit)


def stories_for_tags(library: Library, tag_ids: list[int], job: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(tag_id, title, id): the pending stories of each wanted tag in title order, a row without a story for a tag that has none.

    Rows, not lists, so that a tag on very many stories is paged like any other.
    """
    wanted = library.spark.createDataFrame([(t,) for t in tag_ids], "tag_id bigint")
    links = pending(library, job).where(F.col("tag_id").isin(tag_ids)).select("story_id", "tag_id").distinct()
    rows = links.join(library.stories.select(F.col("id").alias("story_id"), F.coalesce("title", F.lit("")).alias("title")), "story_id")
    out = wanted.join(rows, "tag_id", "left").select("tag_id", "title", F.col("story_id").alias("id")).orderBy("tag_id", "title", "id")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def by_story(library: Library, job: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """(id, title, author, tags): a page of stories with their pending tag names."""
    links = pending(library, job).select("story_id", "tag_id").distinct()
    ids = links.select(F.col("story_id").alias("id")).distinct()
    shown = library.stories.select("id", "title", "author").join(ids, "id").orderBy("title", "id")
    shown = (shown.offset(offset) if offset else shown).limit(limit)
    names = links.join(library.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    rows = shown.join(names, F.col("id") == F.col("story_id"))
    return rows.groupBy("id", "title", "author").agg(F.sort_array(F.collect_list("name")).alias("tags"))
