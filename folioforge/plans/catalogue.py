"""Registered queries of the library operators, with fixed example arguments."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.model import Library, duplicated, latest, orphans
from folioforge.operators import clustering, facets, jobs, listing, mutate, review, search
from folioforge.plans import flows, sql
from folioforge.sources import files
from folioforge.storage import shared_folder
from folioforge.streaming.drop import event_counts

Query = Callable[[SparkSession, str], DataFrame]
SITE, NOW = "fa", "2026-01-01T00:00:00Z"


def _first_story(library: Library) -> str:
    return library.table("stories").agg(F.min("id")).first()[0]


def _hot_group(library: Library) -> str:
    return library.stories.groupBy("group_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_id").first()[0]


def _author(library: Library) -> str:
    return library.active.where("author is not null").groupBy("author").agg(F.count_distinct("group_id").alias("n")).orderBy(F.desc("n"), "author").first()[0]


def _tagged_story(library: Library) -> str:
    return library.story_site_tags.groupBy("story_id").agg(F.count_distinct("code").alias("n")).orderBy(F.desc("n"), "story_id").first()[0]


_indexes: dict[tuple[str, str], search.Index] = {}


def _index(library: Library) -> search.Index:
    """The library's search index, stored once per application."""
    key = (library.spark.sparkContext.applicationId, library.path)
    if key not in _indexes:
        _indexes[key] = search.Index.of(library.stories).stored(f"{shared_folder(library.spark)}/search-{uuid.uuid4().hex[:12]}")
    return _indexes[key]


def _upserted(library: Library) -> DataFrame:
    new = library.stories.where("part_index = 1").withColumn("title", F.concat(F.lit("New "), F.coalesce("title", F.lit("")))).withColumn("tags", F.array(F.lit("fa"))).drop("status", "removed_at")
    return mutate.upsert_stories(library.stories, new).select("id", "group_id", "part_index", "title", "status", "removed_at")


def _blocks(library: Library) -> DataFrame:
    items = library.tag_candidates.where("job_id is not null").select("job_id", F.col("id").alias("item"))
    rows = items.join(library.jobs.select(F.col("id").alias("job_id"), "model", "created_at"), "job_id")
    return jobs.block_schedule(rows).select("job_id", "item", "round", "turn")


def _link_columns(df: DataFrame) -> DataFrame:
    return df.select("story_id", "tag_id", "source", "job_id")


def _clustered(library: Library) -> dict[str, DataFrame]:
    histogram = facets.text_histogram(library)
    clusters = histogram.select("tag_text", X.folded(F.trim("tag_text")).alias("cluster")).where("cluster <> ''")
    names = clustering.cluster_names(clusters, histogram)
    return mutate.write_clusters(library.tag_candidates, library.tags, library.links, names, NOW, 999)


def _pairs(library: Library) -> DataFrame:
    return clustering.similar_pairs(library.table("embeddings"), "vec_id", "embedding", 0.4).withColumn("similarity", F.round("similarity", 6))


def _by_library(query: Callable[[Library], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(Library(spark, sf_dir))


def queries() -> dict[str, Query]:
    named: dict[str, Callable[[Library], DataFrame]] = {
        # listing
        "browse_page1": lambda x: listing.browse(x),
        "browse_page2": lambda x: listing.browse(x, limit=50, offset=50),
        "browse_include_tags": lambda x: listing.browse(x, include=(1, 3), limit=None),
        "browse_exclude_tags": lambda x: listing.browse(x, exclude=(1, 2), limit=None),
        "browse_include_exclude": lambda x: listing.browse(x, include=(1,), exclude=(3, 5), limit=None),
        "sort_keys": lambda x: listing.listing(x).select("id", "title", X.sort_key(F.col("title")).alias("sort_key")),
        "stories_for_tag": lambda x: listing.for_tag(x, 1),
        "count_stories_for_tag": lambda x: listing.count_for_tag(x, 1),
        "stories_for_site_tag": lambda x: listing.for_site_tag(x, SITE, None),
        "count_stories_for_site_tag": lambda x: listing.count_for_site_tag(x, SITE),
        "stories_for_author": lambda x: listing.for_author(x, _author(x)),
        "count_stories_for_author": lambda x: listing.count_for_author(x, _author(x)),
        "more_by_author": lambda x: listing.more_by_author(x, _author(x), _hot_group(x)),
        "group_parts": lambda x: listing.group_parts(x, _hot_group(x)),
        "removed_stories": lambda x: listing.removed(x),
        "count_removed": lambda x: listing.count_removed(x),
        "story_by_id": lambda x: listing.story(x, _first_story(x)).select("id", "title", "content_hash"),
        "random_sample_size": lambda x: listing.random_stories(x, 10).agg(F.count("*").alias("stories"), F.count_distinct("id").alias("ids"), F.count_if(F.col("status") == "active").alias("active")),
        # facets
        "tag_counts": lambda x: facets.tag_counts(x),
        "site_tag_counts": lambda x: facets.site_tag_counts(x),
        "tag_autocomplete": lambda x: facets.autocomplete(x, "Wid_wed"),
        "tag_cloud": lambda x: facets.tag_cloud(x),
        "tag_cloud_size": lambda x: facets.tag_cloud_size(x),
        "count_tags": lambda x: facets.count_matching(x.tags, "name", "masq"),
        "count_site_tags": lambda x: facets.count_matching(x.site_tags, "label", "s"),
        "count_prompts": lambda x: facets.count_matching(x.prompts, "name", "TONE"),
        "tags_of_story": lambda x: facets.tags_of(x, _first_story(x)),
        "site_tags_of_story": lambda x: facets.site_tags_of(x, _tagged_story(x)),
        "prompts_page": lambda x: facets.prompts(x),
        "prompt_lineage": lambda x: facets.prompt_lineage(x),
        "tag_by_name": lambda x: facets.equal_to(x.tags, name="sea witch").select("id", "name"),
        "tag_by_id": lambda x: facets.equal_to(x.tags, id=7).select("id", "name"),
        "site_tag_by_code": lambda x: facets.equal_to(x.site_tags, code=SITE),
        "prompt_by_id": lambda x: facets.equal_to(x.prompts, id=2).select("id", "name", "based_on_id"),
        "has_candidates": lambda x: facets.has_candidates(x, "v1"),
        "pending_candidates": lambda x: facets.pending_candidates(x),
        "scope_untagged": lambda x: facets.in_scope(x, "untagged"),
        "scope_resume": lambda x: facets.in_scope(x, None, 1),
        "candidate_histogram": lambda x: facets.text_histogram(x),
        # search
        "search_parts_bm25": lambda x: search.parts(x, _index(x), "lighthouse café", with_snippet=False).withColumn("r", F.round("r", 6)),
        "search_works_bm25": lambda x: search.works(x, _index(x), "harbour kettle").withColumn("r", F.round("r", 6)),
        "search_phrase": lambda x: search.parts(x, _index(x), "way-home !!!", with_snippet=False).withColumn("r", F.round("r", 6)),
        "search_with_tags": lambda x: search.works(x, _index(x), "kettle", include=(1,), exclude=(3,)).withColumn("r", F.round("r", 6)),
        "search_nothing": lambda x: search.parts(x, _index(x), "!!!", with_snippet=False),
        "search_snippets": lambda x: search.parts(x, _index(x), "teapot").select("id", "snippet"),
        "posting_sizes": lambda x: search.postings(x.stories).groupBy("token", "field").agg(F.count("*").alias("stories"), F.sum(F.size("positions")).alias("hits")),
        # review
        "pending_counts": lambda x: review.counts(x),
        "pending_counts_job": lambda x: review.counts(x, 3),
        "pending_tags": lambda x: review.by_tag(x),
        "pending_tags_job": lambda x: review.by_tag(x, 3),
        "pending_stories_by_tag": lambda x: review.stories_for_tags(x, [2, 3, 999999]),
        "pending_by_story": lambda x: review.by_story(x).select("id", "title", "author", F.array_join("tags", ";").alias("tags")),
        # jobs
        "jobs_page": lambda x: jobs.listed(x),
        "jobs_extract_done": lambda x: jobs.listed(x, status="done", kind="extract"),
        "jobs_count": lambda x: jobs.count(x, status="queued"),
        "job_detail": lambda x: jobs.one(x, 2),
        "active_jobs": lambda x: jobs.active(x.jobs).select("id", "type", "status", "model", "created_at"),
        "job_completion": lambda x: jobs.completion(jobs.block_timed(jobs.running(x.jobs, 5, NOW, 1), 5, 30.0, 10)).withColumn("eta_seconds", F.round("eta_seconds", 6)),
        "block_schedule": _blocks,
        "jobs_reaped": lambda x: jobs.reaped(jobs.running(x.jobs, 4, NOW, 77), [], NOW).select("id", "status", "error"),
        "jobs_cancelled": lambda x: jobs.cancelled(x.jobs, 4, NOW).select("id", "status", "finished_at"),
        "jobs_progressed": lambda x: jobs.progressed(x.jobs, x.tag_candidates.where("job_id is not null").select("job_id", F.lit(1).alias("done"), F.lit(0).alias("failed"))).select("id", "done", "failed"),
        "jobs_created": lambda x: jobs.create(x.jobs, "sync", NOW).select("id", "type", "status", "total"),
        # mutations
        "mut_upsert_stories": _upserted,
        "mut_link_absent": lambda x: _link_columns(mutate.link(x.links, x.story_site_tags.select("story_id", F.lit(2).cast("bigint").alias("tag_id"), F.lit("model").alias("source"), F.lit(5).cast("bigint").alias("job_id")))),
        "mut_label_upsert": lambda x: mutate.upsert_site_tags(x.site_tags, x.site_tags.select("code", F.when(F.col("code") < "h", F.col("code")).otherwise(F.concat(F.lit("New "), "label")).alias("label"))),
        "mut_merge_tags": lambda x: _link_columns(mutate.merge_tags(x.tags, x.links, 1, 3)[1]),
        "mut_delete_tag": lambda x: _link_columns(mutate.delete_tag(x.tags, x.links, 1)[1]),
        "mut_rename_tag": lambda x: mutate.rename_tag(x.tags, 5, "renamed").select("id", "name"),
        "mut_approve_tag": lambda x: _link_columns(mutate.approve(x.links, tag_id=1, job=3)),
        "mut_reject_tag": lambda x: _link_columns(mutate.reject(x.links, tag_id=1)),
        "mut_approve_story": lambda x: _link_columns(mutate.approve(x.links, story_id=_first_story(x))),
        "mut_revert_job": lambda x: mutate.revert_job(x.jobs, x.tag_candidates, x.links, x.tags, 3, NOW)["tags"].select("id", "name"),
        "mut_revert_links": lambda x: _link_columns(mutate.revert_job(x.jobs, x.tag_candidates, x.links, x.tags, 3, NOW)["story_tags"]),
        "mut_status": lambda x: mutate.set_status(x.stories, [_first_story(x)], "removed", NOW).select("id", "status", "removed_at"),
        "mut_new_tags": lambda x: mutate.get_or_create_tags(x.tags, x.site_tags.select(F.lower("label").alias("name")), NOW).select("id", "name"),
        "mut_manual_story": lambda x: mutate.manual_story(x.stories, "manual-1", "T", "A", "Body", NOW).select("id", "content_hash", "source_relpath", "status"),
        "mut_write_clusters": lambda x: _link_columns(_clustered(x)["story_tags"]),
        "mut_clustered_marks": lambda x: _clustered(x)["tag_candidates"].groupBy("status").agg(F.count("*").alias("n")),
        # vectors
        "cosine_pairs": _pairs,
        "label_centroids": lambda x: clustering.centroids(x.table("embeddings"), "label", "embedding").withColumn("value", F.round("value", 6)),
        "nearest_centroid": lambda x: clustering.nearest_centroid(x.table("embeddings"), "vec_id", "embedding", "label").withColumn("similarity", F.round("similarity", 5)),
        "greedy_clusters": lambda x: clustering.greedy(x.table("embeddings"), "vec_id", "embedding", 0.3),
        # text
        "context_sizes": lambda x: x.stories.select("id", X.context_size(F.length(F.coalesce("body_text", F.lit(""))) * 8, F.lit(32768)).alias("context")).groupBy("context").agg(F.count("*").alias("stories")),
        "body_limits": lambda x: x.jobs.select("id", X.body_limit(X.effective_context(F.lit(16384), (F.col("id") * 4096).cast("int"))).alias("chars")),
        "durations": lambda x: x.jobs.select("id", X.duration((F.col("total") * 97 * (F.col("id") * F.col("id"))).cast("double")).alias("text")),
        "signature_ids": lambda x: files.with_hashes(x.stories.select(F.col("source_relpath").alias("relpath"), F.col("group_id").alias("group_key"), "part_index", "title", "author", F.coalesce("body_text", F.lit("")).alias("body_text"), F.array().cast("array<string>").alias("tags")), NOW).select("id", "group_id", "content_hash"),
        # checks and events
        "repeated_story_ids": lambda x: duplicated(x.table("stories"), ["id"]),
        "orphan_links": lambda x: orphans(x.story_tags, "story_id", x.active, "id").select("story_id", "tag_id"),
        "latest_rows": lambda x: latest(x.table("stories")).select("id", "ingested_at", "status"),
        "event_windows": lambda x: event_counts(x.table("events")).withColumn("total", F.round("total", 4)),
        "scope_words": lambda x: x.jobs.select("id", F.get_json_object("scope", "$.limit").alias("most"), F.when(F.col("scope").startswith("{"), None).otherwise(F.col("scope")).alias("word")),
    }
    return {name: _by_library(q) for name, q in (named | flows.queries()).items()}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql() | flows.oracle_sql()
