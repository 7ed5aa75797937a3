"""Jobs: rows and their changes, progress, block schedule and completion times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import duration
from folioforge.model import Library
from folioforge.operators.facets import equal_to
from folioforge.operators.mutate import update, with_ids

SCHEDULED = ("extract", "cluster")
ACTIVE = ("queued", "running")
BLOCK = 10


def _named(jobs: DataFrame, library: Library) -> DataFrame:
    names = library.prompts.select(F.col("id").alias("prompt_id"), F.col("name").alias("prompt_name"))
    return jobs.join(names, "prompt_id", "left")


SHOWN = ("id", "type", "status", "prompt_id", "prompt_name", "model", "scope", "total", "done", "failed", "created_at")


def listed(library: Library, status: str | None = None, kind: str | None = None, limit: int = 25, offset: int = 0) -> DataFrame:
    rows = _named(equal_to(library.jobs, status=status, type=kind), library).select(*SHOWN).orderBy(F.desc("created_at"), F.desc("id"))
    return (rows.offset(offset) if offset else rows).limit(limit)


def count(library: Library, status: str | None = None, kind: str | None = None) -> DataFrame:
    return equal_to(library.jobs, status=status, type=kind).agg(F.count("*").alias("jobs"))


def one(library: Library, job: int) -> DataFrame:
    return _named(library.jobs.where(F.col("id") == job), library).select(*SHOWN)


def errors(job_errors: DataFrame, job: int, limit: int = 200) -> DataFrame:
    return job_errors.where(F.col("job_id") == job).orderBy("id").limit(limit)


def active(jobs: DataFrame) -> DataFrame:
    """Queued and running jobs of the scheduler, by model (null first) and age."""
    rows = jobs.where(F.col("status").isin(*ACTIVE) & F.col("type").isin(*SCHEDULED))
    return rows.orderBy(F.asc_nulls_first("model"), "created_at", "id")


def block_schedule(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(job_id, item, round, turn) for ``items``(job_id, model, created_at, item): each round gives every job one block,
    jobs of a model in a row.  Ordered by (round, model, created_at, job_id, item) this is the whole run."""
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("item"))
    return items.withColumn("round", F.floor((n - 1) / block).cast("bigint")).withColumn("turn", (n - 1) % block)


def completion(jobs: DataFrame) -> DataFrame:
    """(id, eta_seconds, eta): jobs share one worker evenly; the one with least left ends first and frees its share.

    Null where a job's last block has no time or items; the active jobs of one scheduler are few, so one window holds them.
    """
    remaining = F.col("total") - F.col("done") - F.col("failed")
    known = (F.coalesce("last_block_items", F.lit(0)) != 0) & (F.coalesce("last_block_seconds", F.lit(0.0)) != 0)
    own = F.when(known, F.when(remaining <= 0, 0.0).otherwise(remaining * F.col("last_block_seconds") / F.col("last_block_items")))
    timed = active(jobs).select("id", "status", own.alias("own")).where("own is not null")
    order = Window.orderBy("own", "id")
    step = (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1) * (F.col("own") - F.lag("own", 1, 0.0).over(order))
    done = timed.withColumn("step", step).withColumn("eta_seconds", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("id", "eta_seconds")
    shown = F.when(F.col("status") == "running", duration(F.col("eta_seconds")))
    return active(jobs).select("id", "status").join(done, "id", "left").select("id", "eta_seconds", shown.alias("eta"))


# -- changes ---------------------------------------------------------------------------------------------


def create(jobs: DataFrame, kind: str, now: str, prompt_id: int | None = None, model: str | None = None, scope: str | None = None) -> DataFrame:
    new = jobs.sparkSession.range(1).select(F.lit(kind).alias("type"), F.lit("queued").alias("status"), F.lit(prompt_id).cast("bigint").alias("prompt_id"), F.lit(model).cast("string").alias("model"), F.lit(scope).cast("string").alias("scope"), F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("done"), F.lit(0).cast("bigint").alias("failed"), F.lit(now).alias("created_at"))
    return jobs.unionByName(with_ids(new, jobs, ["type"]), allowMissingColumns=True)


def _at(job: int) -> Column:
    return F.col("id") == job


def running(jobs: DataFrame, job: int, now: str, pid: int) -> DataFrame:
    return update(jobs, _at(job), status="running", started_at=now, pid=pid)


def set_total(jobs: DataFrame, job: int, total: int) -> DataFrame:
    return update(jobs, _at(job), total=total)


def progressed(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Counters increased by ``log``(job_id, done, failed), many events at once."""
    more = log.groupBy(F.col("job_id").alias("id")).agg(F.sum("done").alias("_d"), F.sum("failed").alias("_f"))
    return jobs.join(more, "id", "left").withColumn("done", F.col("done") + F.coalesce("_d", F.lit(0))).withColumn("failed", F.col("failed") + F.coalesce("_f", F.lit(0))).select(*jobs.columns)


def block_timed(jobs: DataFrame, job: int, seconds: float, items: int) -> DataFrame:
    return update(jobs, _at(job), last_block_seconds=float(seconds), last_block_items=items)


def finished(jobs: DataFrame, job: int, now: str) -> DataFrame:
    return update(jobs, _at(job), status="done", finished_at=now)


def failed(jobs: DataFrame, job: int, error: str, now: str) -> DataFrame:
    return update(jobs, _at(job), status="failed", error=error, finished_at=now)


def cancelled(jobs: DataFrame, job: int, now: str) -> DataFrame:
    """A queued or running job ends as failed; others stay."""
    return update(jobs, _at(job) & F.col("status").isin(*ACTIVE), status="failed", error="cancelled", finished_at=now)


def reset(jobs: DataFrame, job: int) -> DataFrame:
    return update(jobs, _at(job), done=0, failed=0)


def reaped(jobs: DataFrame, alive: list[int], now: str) -> DataFrame:
    """Running jobs without a living process fail; those the scheduler takes up again only if they never had a process."""
    lost = F.col("pid").isNull() | (~F.col("pid").isin(*alive) & ~F.col("type").isin(*SCHEDULED)) if alive else F.col("pid").isNull() | ~F.col("type").isin(*SCHEDULED)
    return update(jobs, (F.col("status") == "running") & lost, status="failed", error="the process is gone", finished_at=now)


def record_error(job_errors: DataFrame, job: int, story: str, error: str, now: str) -> DataFrame:
    new = job_errors.sparkSession.range(1).select(F.lit(job).cast("bigint").alias("job_id"), F.lit(story).alias("story_ref"), F.lit(error).alias("error"), F.lit(now).alias("created_at"))
    return job_errors.unionByName(with_ids(new, job_errors, ["story_ref"]))


def unfinished(jobs: DataFrame) -> DataFrame:
    """The number of jobs for which a worker must be there."""
    return active(jobs).agg(F.count("*").alias("jobs"))
