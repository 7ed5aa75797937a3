"""Listings of works: one row per group, led by its earliest active part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import effective_title, sort_key
from folioforge.model import Library


def representatives(active: DataFrame) -> DataFrame:
    """(group_id, part_index, part_count): the earliest active part of each group and how many there are."""
    return active.groupBy("group_id").agg(F.min("part_index").alias("part_index"), F.count("*").alias("part_count"))


def titled(rows: DataFrame, stories: DataFrame) -> DataFrame:
    """``rows`` with the effective title; part 0 lends its title even if it was removed.

    Part indexes may repeat within a group; every such part 0 gives a row, as with the plain join.
    """
    first = stories.where("part_index = 0").select("group_id", F.col("title").alias("_first"))
    return rows.join(first, "group_id", "left").withColumn("title", effective_title(F.col("title"), F.col("_first"))).drop("_first")


def groups_with_all(library: Library, tag_ids: list[int]) -> DataFrame:
    """Groups that hold every tag on some active part, in one pass over the links."""
    wanted = sorted(set(tag_ids))
    links = library.story_tags.where(F.col("tag_id").isin(wanted)).select("story_id", "tag_id").distinct()
    parts = library.active.select(F.col("id").alias("story_id"), "group_id")
    return links.join(parts, "story_id").groupBy("group_id").agg(F.countDistinct("tag_id").alias("k")).where(F.col("k") == len(wanted)).select("group_id")


def groups_with_any(library: Library, tag_ids: list[int]) -> DataFrame:
    links = library.story_tags.where(F.col("tag_id").isin(sorted(set(tag_ids)))).select("story_id").distinct()
    return library.active.select(F.col("id").alias("story_id"), "group_id").join(links, "story_id", "left_semi").select("group_id").distinct()


def listing(library: Library) -> DataFrame:
    """(id, group_id, part_index, title, author, part_count) of every group's leading part; body text isn't read."""
    active = library.active.select("id", "group_id", "part_index", "title", "author")
    rows = active.join(representatives(active), ["group_id", "part_index"])
    return titled(rows, library.stories.select("group_id", "part_index", "title")).select("id", "group_id", "part_index", "title", "author", "part_count")


def page(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """A page in title order; the id breaks ties."""
    rows = rows.orderBy(sort_key(F.col("title")), "id", "title")
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def page_offset(number: int, size: int) -> tuple[int, int]:
    """(page, offset) of a requested page; pages below 1 count as 1."""
    number = max(number, 1)
    return number, (number - 1) * size


def parse_ids(raw: str) -> list[int]:
    """Ids of a comma list; parts that are no numbers are left out, repeats stay."""
    return [int(p) for p in map(str.strip, raw.split(",")) if p.isdecimal()]


def browse(library: Library, include: tuple[int, ...] = (), exclude: tuple[int, ...] = (), limit: int | None = 50, offset: int = 0) -> DataFrame:
    """A page of works that hold every included tag and none of the excluded ones on any active part."""
    return page(filtered(listing(library), library, include, exclude), limit, offset)


def filtered(rows: DataFrame, library: Library, include: tuple[int, ...], exclude: tuple[int, ...]) -> DataFrame:
    if include:
        rows = rows.join(groups_with_all(library, list(include)), "group_id", "left_semi")
    if exclude:
        rows = rows.join(groups_with_any(library, list(exclude)), "group_id", "left_anti")
    return rows


def for_tag(library: Library, tag_id: int, limit: int | None = 50, offset: int = 0) -> DataFrame:
    return browse(library, (tag_id,), (), limit, offset)


def count_for_tag(library: Library, tag_id: int) -> DataFrame:
    return groups_with_all(library, [tag_id]).agg(F.count("*").alias("works"))


def _groups_for_code(library: Library, code: str) -> DataFrame:
    links = library.story_site_tags.where(F.col("code") == code).select("story_id")
    return library.active.select(F.col("id").alias("story_id"), "group_id").join(links, "story_id", "left_semi").select("group_id").distinct()


def for_site_tag(library: Library, code: str, limit: int | None = 50, offset: int = 0) -> DataFrame:
    return page(listing(library).join(_groups_for_code(library, code), "group_id", "left_semi"), limit, offset)


def count_for_site_tag(library: Library, code: str) -> DataFrame:
    return _groups_for_code(library, code).agg(F.count("*").alias("works"))


def for_author(library: Library, author: str, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Works whose leading part has this author."""
    return page(listing(library).where(F.col("author") == author), limit, offset)


def count_for_author(library: Library, author: str) -> DataFrame:
    """Works with the author on any active part, which may be more than ``for_author`` lists."""
    return library.active.where(F.col("author") == author).agg(F.countDistinct("group_id").alias("works"))


def more_by_author(library: Library, author: str, group_id: str, limit: int = 10) -> DataFrame:
    return page(listing(library).where((F.col("author") == author) & (F.col("group_id") != group_id)), limit)


def group_parts(library: Library, group_id: str) -> DataFrame:
    """All parts of a work in reading order, removed ones too."""
    return library.stories.where(F.col("group_id") == group_id).select("id", "part_index", "title", "status").orderBy("part_index", "id")


def removed(library: Library, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = library.stories.where("status = 'removed'").select("id", "title", "author", "removed_at").orderBy(F.desc("removed_at"), "id")
    return (rows.offset(offset) if offset else rows).limit(limit)


def count_removed(library: Library) -> DataFrame:
    return library.stories.where("status = 'removed'").agg(F.count("*").alias("stories"))


def random_stories(library: Library, n: int, seed: int = 7) -> DataFrame:
    """A uniform sample of active stories: ids are drawn first, the wide rows joined afterwards."""
    ids = library.active.select("id").orderBy(F.rand(seed)).limit(n)
    return library.stories.join(F.broadcast(ids), "id", "left_semi") if n <= 10_000 else library.stories.join(ids, "id", "left_semi")


def story(library: Library, story_id: str) -> DataFrame:
    return library.stories.where(F.col("id") == story_id)
