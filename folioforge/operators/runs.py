"""Whole jobs over a library: tables in, tables out, with the job's own row carried through its states.

``tables`` is a dict of DataFrames as ``model.opened`` gives it; what comes back holds the changed ones only, so
``model.commit`` stores them as one version.  A failure that ends a job leaves the tables as they were, but for the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from folioforge.model import SCHEMAS, SIGNATURE
from folioforge.operators import clustering, jobs, mutate, tagging
from folioforge.operators.mutate import with_ids
from folioforge.sources import adapters, files

Tables = dict[str, DataFrame]
CHARS = 100_000


class View:
    """Tables of a dict behind the names that operators over a library use."""

    def __init__(self, tables: Tables):
        self.tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        return self.tables[name]

    @property
    def active(self) -> DataFrame:
        return self.tables["stories"].where("status = 'active'")


def job_row(tables: Tables, job: int) -> Row:
    row = tables["jobs"].where(F.col("id") == job).first()
    if row is None:
        raise ValueError(f"no such job: {job}")
    return row


def signature_of(stories: DataFrame) -> DataFrame:
    """Stories back as signature records, without tags."""
    return stories.select(*(F.col(f.name) if f.name in stories.columns else F.array().cast(f.dataType).alias(f.name) for f in SIGNATURE.fields))


def errors_of(lost: DataFrame, job: int, now: str) -> DataFrame:
    """Rows for the error table of ``lost``(story_ref, error)."""
    return lost.select(F.lit(job).cast("bigint").alias("job_id"), "story_ref", "error", F.lit(now).alias("created_at"))


def appended(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    return old.unionByName(with_ids(new, old, order).select(*old.columns))


def ended(tables: Tables, job: int, now: str, pid: int, done: int, failed: int, total: int) -> DataFrame:
    """The jobs after a run: started, counted and done, in one pass over the table."""
    return mutate.update(tables["jobs"], F.col("id") == job, status="done", started_at=now, finished_at=now, pid=pid, total=total, done=F.col("done") + done, failed=F.col("failed") + failed)


# -- sync -------------------------------------------------------------------------------------------------


def parsed(pages: DataFrame, adapter) -> tuple[DataFrame, DataFrame]:
    """(fields, lost): what an adapter makes of (relpath, text), and (story_ref, error) of pages that it can't read."""
    unread = pages.where("text is null").select(F.col("relpath").alias("story_ref"), F.lit("the file holds no text").alias("error"))
    fields = adapter.apply(pages.where("text is not null"))
    if "error" not in fields.columns:
        return fields, unread
    bad = fields.where("error is not null").select(F.col("relpath").alias("story_ref"), "error")
    return fields.where("error is null").drop("error"), unread.unionByName(bad)


def sync(tables: Tables, job: int, pages: DataFrame, adapter, now: str, pid: int = 0, keep_media: bool = False) -> Tables:
    """Every story page of an archive into the library; a page that can't be read costs itself only."""
    fields, lost = parsed(pages, adapter)
    records = files.with_hashes(fields, now)
    if keep_media:
        records = records.withColumn("media_path", F.col("source_relpath"))
    records, lost = records.persist(StorageLevel.MEMORY_AND_DISK), lost.persist(StorageLevel.MEMORY_AND_DISK)
    done, failed = records.count(), lost.count()
    out = {
        "stories": mutate.upsert_stories(tables["stories"], records).select(*SCHEMAS["stories"].names),
        "story_site_tags": mutate.signature_site_links(tables["story_site_tags"], records),
        "site_tags": mutate.upsert_site_tags(tables["site_tags"], records.select(F.explode("tags").alias("code")).distinct().withColumn("label", F.col("code"))),
        "jobs": ended(tables, job, now, pid, done, failed, done + failed),
    }
    return out | ({"job_errors": appended(tables["job_errors"], errors_of(lost, job, now), ["story_ref"])} if failed else {})


def run_sync(tables: Tables, row: Row, now: str, pid: int) -> Tables:
    """A sync job by the adapter, archive and glob in its scope."""
    asked = json.loads(row.scope or "{}")
    if not asked.get("adapter") or not asked.get("archive_root"):
        raise ValueError("the sync job names no adapter or archive_root")
    found = files.archive(tables["jobs"].sparkSession, asked["archive_root"], asked.get("glob") or "*.html")
    pages = found.select("relpath", files.file_text(F.col("relpath"), F.col("content")).alias("text"))
    return sync(tables, row.id, pages, adapters.load(asked["adapter"], **(asked.get("config") or {})), now, pid, bool(asked.get("save_media_path")))


# -- extract ----------------------------------------------------------------------------------------------


def prompt_of(tables: Tables, row: Row) -> Row:
    prompt = None if row.prompt_id is None else tables["prompts"].where(F.col("id") == row.prompt_id).first()
    if prompt is None:
        raise ValueError("the job has no prompt")
    return prompt


def extract(tables: Tables, row: Row, model: Callable[[], tagging.TagModel], now: str, pid: int = 0, most_chars: int = CHARS, most_items: int | None = None) -> Tables:
    """Proposals for every story in the job's scope that it has none for yet, or for the first ``most_items`` of them."""
    prompt = prompt_of(tables, row)
    todo = tables["stories"].join(tagging.in_scope(View(tables), row.scope, row.id).select("id"), "id", "left_semi")
    ref = F.concat(F.coalesce("title", F.lit("")), F.lit(" ("), "id", F.lit(")"))
    if most_items is not None:  # a block: what failed in an earlier one isn't tried again
        tried = tables["job_errors"].where(F.col("job_id") == row.id).select("story_ref")
        todo = todo.withColumn("story_ref", ref).join(tried, "story_ref", "left_anti").drop("story_ref").orderBy("id").limit(most_items)
    out = tagging.propose(todo, prompt.text, model, most_chars).persist(StorageLevel.MEMORY_AND_DISK)
    n = out.agg(F.count("error").alias("failed"), F.count("*").alias("all")).first()
    new = out.where("error is null").select(F.col("id").alias("story_id"), F.explode("tags").alias("tag_text"), F.lit(prompt.name).alias("prompt_version"), F.lit(row.model).cast("string").alias("model"), F.lit(now).alias("created_at"), F.lit("candidate").alias("status"), F.lit(row.id).cast("bigint").alias("job_id"))
    made = {"tag_candidates": appended(tables["tag_candidates"], new, ["story_id", "tag_text"]), "jobs": ended(tables, row.id, now, pid, n["all"] - n.failed, n.failed, n["all"])}
    lost = out.where("error is not null").join(todo.select("id", "title"), "id").select(ref.alias("story_ref"), "error")
    return made | ({"job_errors": appended(tables["job_errors"], errors_of(lost, row.id, now), ["story_ref"])} if n.failed else {})


def previewed(stories: DataFrame, template: str, model: Callable[[], tagging.TagModel], most_chars: int = CHARS) -> DataFrame:
    """(id, title, tags, error): what a prompt would give for some stories; nothing is stored."""
    out = tagging.propose(stories, template, model, most_chars)
    return stories.select("id", "title").join(out, "id").select("id", "title", "tags", "error")


# -- cluster ----------------------------------------------------------------------------------------------


def clusters_of(candidates: DataFrame, embedder: Callable[[], tagging.Embedder], threshold: float = clustering.THRESHOLD) -> DataFrame:
    """(tag_text, name) of the pending proposals: every text embedded once, in parallel, then folded in order of first use."""
    histogram = candidates.where("status = 'candidate'").groupBy("tag_text").agg(F.count("*").alias("uses"), F.min("id").alias("first_id"))
    vectors = tagging.embedded(histogram, embedder).join(histogram, "tag_text")
    folded = clustering.greedy(vectors, "first_id", "vector", threshold)
    return clustering.cluster_names(folded.join(histogram.select("tag_text", "first_id"), "first_id").select("tag_text", "cluster"), histogram)


def cluster(tables: Tables, row: Row, embedder: Callable[[], tagging.Embedder], now: str, pid: int = 0, threshold: float = clustering.THRESHOLD) -> Tables:
    names = clusters_of(tables["tag_candidates"], embedder, threshold).persist(StorageLevel.MEMORY_AND_DISK)
    n = names.count()
    return mutate.write_clusters(tables["tag_candidates"], tables["tags"], tables["story_tags"], names, now, row.id) | {"jobs": ended(tables, row.id, now, pid, n, 0, n)}


# -- any job ----------------------------------------------------------------------------------------------


def run_job(tables: Tables, job: int, now: str, pid: int = 0, model: Callable | None = None, embedder: Callable | None = None, most_chars: int = CHARS) -> Tables:
    """Runs a job by its type.  Whatever ends it early leaves it failed, with the reason, and nothing else changed."""
    row = job_row(tables, job)
    runners: dict[str, Callable[[], Tables]] = {
        "sync": lambda: run_sync(tables, row, now, pid),
        "extract": lambda: extract(tables, row, model, now, pid, most_chars),
        "cluster": lambda: cluster(tables, row, embedder, now, pid),
    }
    try:
        if row.type not in runners:
            raise ValueError(f"no runner for jobs of type {row.type}")
        return runners[row.type]()
    except Exception as e:  # noqa: BLE001
        return {"jobs": jobs.failed(tables["jobs"], job, str(e).splitlines()[0] if str(e) else type(e).__name__, now)}


def seeded(tables: Tables, name: str, template: str | None, now: str) -> Tables:
    """A first prompt for a library without any; nothing if the template couldn't be read."""
    return {} if template is None else {"prompts": mutate.seed_prompt(tables["prompts"], name, template, now)}

