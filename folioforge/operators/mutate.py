"""Keyed writes as pure functions: old tables in, new tables out; ``model.commit`` stores the result.

All are equi-joins or filters on keys.  New ids go on from the largest one (or a kept high-water mark) in a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.storage import shared_folder

CONTENT = ("group_id", "part_index", "title", "author", "body_text", "source_relpath", "content_hash", "ingested_at", "media_path")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def update(df: DataFrame, where: Column, **values) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.select(*(F.when(hit, values[c] if isinstance(values[c], Column) else F.lit(values[c])).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns))


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def with_ids(new: DataFrame, old: DataFrame, order: list[str], high_water: int | None = None, id_col: str = "id") -> DataFrame:
    """``new`` with ids that follow the largest of ``old``: numbered per range partition, partition totals added up.

    The sorted rows are written once, as their partitions must be the same for the numbers and for the totals.
    """
    base = old.agg(F.max(id_col)).first()[0] or 0
    base = max(base, high_water or 0)
    placed = new.sort(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    shared_folder(new.sparkSession)
    placed = placed.checkpoint()
    totals = placed.groupBy("_p").agg(F.count("*").alias("_c"))
    before = totals.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_m"))
    return placed.join(before, "_p").withColumn(id_col, (F.col("_b") + inside + base).cast("bigint")).drop("_p", "_m", "_b")


# -- stories ---------------------------------------------------------------------------------------------


def upsert_stories(stories: DataFrame, signatures: DataFrame) -> DataFrame:
    """Content of known ids is overwritten, status and removal stay; new ids come in active; the last of equals wins."""
    w = Window.partitionBy("id").orderBy(F.desc("ingested_at"), F.desc("content_hash"))
    new = signatures.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", *CONTENT)
    kept = stories.select("id", "status", "removed_at")
    merged = new.join(kept, "id", "left").withColumn("status", F.coalesce("status", F.lit("active")))
    return stories.join(new.select("id"), "id", "left_anti").unionByName(merged)


def signature_site_links(links: DataFrame, signatures: DataFrame) -> DataFrame:
    """Site-tag links are only added."""
    new = signatures.select(F.col("id").alias("story_id"), F.explode("tags").alias("code"))
    return insert_absent(links, new, ["story_id", "code"])


def set_status(stories: DataFrame, ids: list[str], status: str, now: str) -> DataFrame:
    return update(stories, F.col("id").isin(ids), status=status, removed_at=F.lit(now if status == "removed" else None).cast("string"))


def manual_story(stories: DataFrame, story_id: str, title: str, author: str, body: str, now: str) -> DataFrame:
    row = stories.sparkSession.range(1).select(
        F.lit(story_id).alias("id"), F.lit(story_id).alias("group_id"), F.lit(0).alias("part_index"), F.lit(title).alias("title"), F.lit(author).alias("author"), F.lit(body).alias("body_text"),
        F.lit("manual-entry").alias("source_relpath"), F.sha1(F.lit(body)).alias("content_hash"), F.lit(now).alias("ingested_at"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("removed_at"), F.lit(None).cast("string").alias("media_path"),
    )
    return stories.unionByName(row)


# -- tags and links --------------------------------------------------------------------------------------


def insert_candidates(candidates: DataFrame, story_id: str, tags: list[str], version: str, model: str, now: str, job: int | None) -> DataFrame:
    spark = candidates.sparkSession
    new = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "n int, tag_text string")
    rows = with_ids(new, candidates, ["n"]).select("id", F.lit(story_id).alias("story_id"), "tag_text", F.lit(version).alias("prompt_version"), F.lit(model).alias("model"), F.lit(now).alias("created_at"), F.lit("candidate").alias("status"), F.lit(job).cast("bigint").alias("job_id"))
    return candidates.unionByName(rows)


def get_or_create_tags(tags: DataFrame, names: DataFrame, now: str) -> DataFrame:
    """Tags with every name of ``names``(name); exact names that exist are kept."""
    missing = names.select("name").where("name is not null").distinct().join(tags.select("name"), "name", "left_anti")
    rows = with_ids(missing, tags, ["name"]).select("id", "name", F.lit(None).cast("string").alias("description"), F.lit(now).alias("created_at"))
    return tags.unionByName(rows)


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-if-absent on (story, tag): the first writer's source and job stay."""
    return insert_absent(links, new.select("story_id", "tag_id", F.lit(None).cast("double").alias("confidence"), "source", "job_id"), ["story_id", "tag_id"])


def add_tags_by_name(tags: DataFrame, links: DataFrame, story_id: str, names: list[str], now: str, source: str = "human") -> tuple[DataFrame, DataFrame]:
    wanted = tags.sparkSession.createDataFrame([(n,) for n in names], "name string")
    tags = get_or_create_tags(tags, wanted, now)
    new = tags.join(wanted, "name", "left_semi").select(F.lit(story_id).alias("story_id"), F.col("id").alias("tag_id"), F.lit(source).alias("source"), F.lit(None).cast("bigint").alias("job_id"))
    return tags, link(links, new)


def mark_clustered(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return candidates.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit"), "clustered").otherwise(F.col("status"))).select(*candidates.columns)


def upsert_site_tags(site_tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """A real label beats a stand-in (label = code), a stand-in never beats a real label, a later real label an earlier."""
    new = vocabulary.select("code", F.coalesce("label", F.col("code")).alias("_new")).groupBy("code").agg(F.max(F.struct((F.col("_new") != F.col("code")).alias("real"), F.col("_new").alias("label"))).alias("m")).select("code", F.col("m.label").alias("_new"))
    label = F.when(F.col("label").isNull(), F.col("_new")).when(F.col("_new").isNull() | (F.col("_new") == F.col("code")), F.col("label")).otherwise(F.col("_new"))
    return site_tags.join(new, "code", "full_outer").select("code", label.alias("label"))


def delete_tag(tags: DataFrame, links: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame]:
    return delete(tags, F.col("id") == tag_id), delete(links, F.col("tag_id") == tag_id)


def rename_tag(tags: DataFrame, tag_id: int, name: str) -> DataFrame:
    if not tags.where((F.col("name") == name) & (F.col("id") != tag_id)).isEmpty():
        raise ValueError(f"a tag named {name!r} exists")
    return update(tags, F.col("id") == tag_id, name=name)


def merge_tags(tags: DataFrame, links: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """Links of ``source`` go over to ``target``; where both exist the target's link stays."""
    if source == target:
        return tags, links
    there = links.where(F.col("tag_id") == target).select("story_id")
    moved = links.where(F.col("tag_id") == source).join(there, "story_id", "left_anti").withColumn("tag_id", F.lit(target).cast("bigint"))
    return delete(tags, F.col("id") == source), links.where(F.col("tag_id") != source).unionByName(moved.select(*links.columns))


def delete_link(links: DataFrame, story_id: str, tag_id: int) -> DataFrame:
    return delete(links, (F.col("story_id") == story_id) & (F.col("tag_id") == tag_id))


def set_link_source(links: DataFrame, story_id: str, tag_id: int, source: str) -> DataFrame:
    return update(links, (F.col("story_id") == story_id) & (F.col("tag_id") == tag_id), source=source)


def _pending(tag_id: int | None = None, story_id: str | None = None, job: int | None = None) -> Column:
    where = F.col("source") == "model"
    for column, value in (("tag_id", tag_id), ("story_id", story_id), ("job_id", job)):
        if value is not None:
            where = where & (F.col(column) == value)
    return where


def approve(links: DataFrame, tag_id: int | None = None, story_id: str | None = None, job: int | None = None) -> DataFrame:
    return update(links, _pending(tag_id, story_id, job), source="human")


def reject(links: DataFrame, tag_id: int | None = None, story_id: str | None = None, job: int | None = None) -> DataFrame:
    return delete(links, _pending(tag_id, story_id, job))


def revert_job(jobs: DataFrame, candidates: DataFrame, links: DataFrame, tags: DataFrame, job: int, now: str) -> dict[str, DataFrame]:
    """Takes out a job's proposals and model links, then every tag without links; the job keeps the time."""
    left = delete(links, (F.col("job_id") == job) & (F.col("source") == "model"))
    return {
        "tag_candidates": delete(candidates, F.col("job_id") == job),
        "story_tags": left,
        "tags": tags.join(left.select(F.col("tag_id").alias("id")), "id", "left_semi"),
        "jobs": update(jobs, F.col("id") == job, reverted_at=now),
    }


def write_clusters(candidates: DataFrame, tags: DataFrame, links: DataFrame, clusters: DataFrame, now: str, job: int | None) -> dict[str, DataFrame]:
    """``clusters``(tag_text, name): tags for all names, links for every proposal of a member, proposals marked."""
    tags = get_or_create_tags(tags, clusters.select("name"), now)
    member = clusters.join(tags.select(F.col("id").alias("tag_id"), "name"), "name").select("tag_text", "tag_id")
    rows = candidates.where("status = 'candidate'").join(member, "tag_text").select("id", "story_id", "tag_id")
    new = rows.select("story_id", "tag_id").distinct().select("story_id", "tag_id", F.lit("model").alias("source"), F.lit(job).cast("bigint").alias("job_id"))
    return {"tags": tags, "story_tags": link(links, new), "tag_candidates": mark_clustered(candidates, rows)}


# -- prompts ---------------------------------------------------------------------------------------------


def create_prompt(prompts: DataFrame, name: str, text: str, now: str, based_on: int | None = None) -> DataFrame:
    new = prompts.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(text).alias("text"), F.lit(based_on).cast("bigint").alias("based_on_id"), F.lit(now).alias("created_at"))
    return prompts.unionByName(with_ids(new, prompts, ["name"]).select(*prompts.columns))


def seed_prompt(prompts: DataFrame, name: str, text: str, now: str) -> DataFrame:
    return create_prompt(prompts, name, text, now) if prompts.limit(1).isEmpty() else prompts
