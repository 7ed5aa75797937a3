"""Command line: python -m folioforge.cli COMMAND --library FOLDER ...; models and embedders are given as module:factory."""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
import os
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import paragraphs
from folioforge.model import SCHEMAS, backup, commit, current_version, opened, ready
from folioforge.operators import facets, jobs, mutate, runs, scheduler, tagging
from folioforge.sources import adapters, files


def utc_now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def factory(spec: str) -> Callable:
    """The object that ``module:name`` names."""
    module, _, name = spec.partition(":")
    if not name:
        raise SystemExit(f"expected module:name, got {spec!r}")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise SystemExit(f"can't load {spec}: {e}") from e


def do_parse(spark: SparkSession, a: argparse.Namespace) -> str:
    """An archive into signature files; tells how many files there were and how many gave no story."""
    try:
        adapter = adapters.load(a.adapter, **json.loads(a.config or "{}"))
    except (ImportError, AttributeError) as e:
        raise SystemExit(f"can't load {a.adapter}: {e}") from e
    found = files.archive(spark, a.archive, a.glob)
    fields, lost = runs.parsed(found.select("relpath", files.file_text(F.col("relpath"), F.col("content")).alias("text")), adapter)
    records = files.with_hashes(fields, utc_now()).persist()
    files.write_signatures(records, a.out)
    return f"{records.count()} written, {found.count() - records.count()} skipped, {lost.count()} of them unreadable"


def do_sync(spark: SparkSession, a: argparse.Namespace) -> str:
    """Creates a sync job and runs it at once."""
    tables = opened(spark, a.library)
    scope = {"adapter": a.adapter, "archive_root": a.archive, "glob": a.glob, "config": json.loads(a.config or "{}"), "save_media_path": a.media}
    table = jobs.create(tables["jobs"], "sync", utc_now(), scope=json.dumps(scope)).select(*SCHEMAS["jobs"].names)
    commit(a.library, {"jobs": table})
    job = opened(spark, a.library)["jobs"].agg(F.max("id")).first()[0]
    return do_run(spark, argparse.Namespace(library=a.library, job=job, model=None, embedder=None))


def do_run(spark: SparkSession, a: argparse.Namespace) -> str:
    base, _ = current_version(a.library)
    made = runs.run_job(opened(spark, a.library), a.job, utc_now(), os.getpid(), a.model and factory(a.model), a.embedder and factory(a.embedder))
    commit(a.library, made, base)
    row = runs.job_row(opened(spark, a.library), a.job)
    return f"job {row.id} {row.status}: {row.done} done, {row.failed} failed" + (f", {row.error}" if row.error else "")


def do_extract(spark: SparkSession, a: argparse.Namespace) -> str:
    """A folder of signature files into the library, then proposals for its stories that have none of this prompt."""
    tables = opened(spark, a.library)
    good, bad = files.signatures(spark, a.drop)
    records = good.drop("file")
    stories = mutate.upsert_stories(tables["stories"], records).select(*SCHEMAS["stories"].names)
    todo = stories.join(records.select("id"), "id", "left_semi")
    if not a.force:
        todo = todo.join(facets.has_candidates(runs.View(tables | {"stories": stories}), a.version), "id", "left_anti")
    out = tagging.propose(todo, files.prompt_template(spark, a.prompt), factory(a.model), runs.CHARS).persist()
    new = out.where("error is null").select(F.col("id").alias("story_id"), F.explode("tags").alias("tag_text"), F.lit(a.version).alias("prompt_version"), F.lit(a.model).alias("model"), F.lit(utc_now()).alias("created_at"), F.lit("candidate").alias("status"), F.lit(None).cast("bigint").alias("job_id"))
    commit(a.library, {"stories": stories, "story_site_tags": mutate.signature_site_links(tables["story_site_tags"], records), "tag_candidates": runs.appended(tables["tag_candidates"], new, ["story_id", "tag_text"])})
    return f"{out.where('error is null').count()} stories tagged, {out.where('error is not null').count()} failed, {bad.count()} files set aside"


def do_cluster(spark: SparkSession, a: argparse.Namespace) -> str:
    tables = opened(spark, a.library)
    names = runs.clusters_of(tables["tag_candidates"], factory(a.embedder), a.threshold).persist()
    commit(a.library, mutate.write_clusters(tables["tag_candidates"], tables["tags"], tables["story_tags"], names, utc_now(), None))
    return f"{names.count()} texts in {names.select('name').distinct().count()} tags"


def do_worker(spark: SparkSession, a: argparse.Namespace) -> str:
    if not scheduler.locked(a.library):
        return f"another worker holds {scheduler.lock_path(a.library)}"
    try:
        scheduler.Worker(spark, a.library, lambda _: factory(a.model), lambda _: factory(a.embedder), utc_now, os.getpid()).run(a.idle)
    finally:
        scheduler.unlock(a.library)
    return "nothing left to do"


def do_preview(spark: SparkSession, a: argparse.Namespace) -> str:
    rows = runs.previewed(opened(spark, a.library)["stories"].where(F.col("id").isin(a.story)), files.prompt_template(spark, a.prompt), factory(a.model))
    return "\n".join(f"{r.id}: {r.error or ', '.join(r.tags)}" for r in rows.orderBy("id").collect())


def do_backup(spark: SparkSession, a: argparse.Namespace) -> str:
    return f"version {backup(a.library, a.target)} in {a.target}" if ready(a.library) else "the library isn't whole"


def do_text(spark: SparkSession, a: argparse.Namespace) -> str:
    """The paragraphs of one file, as they would be stored."""
    row = files.archive(spark, a.archive, a.glob).select(paragraphs(files.file_text(F.col("relpath"), F.col("content"))).alias("t")).first()
    return row.t if row else ""


COMMANDS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "parse": (do_parse, ("archive", "adapter", "out")),
    "sync": (do_sync, ("library", "archive", "adapter")),
    "run": (do_run, ("library",)),
    "extract": (do_extract, ("library", "drop", "prompt", "model", "version")),
    "cluster": (do_cluster, ("library", "embedder")),
    "worker": (do_worker, ("library", "model", "embedder")),
    "preview": (do_preview, ("library", "prompt", "model")),
    "backup": (do_backup, ("library", "target")),
    "text": (do_text, ("archive",)),
}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(prog="folioforge")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, needed) in COMMANDS.items():
        own = commands.add_parser(name)
        for option in ("library", "archive", "adapter", "out", "drop", "prompt", "version", "target", "model", "embedder"):
            own.add_argument(f"--{option}", required=option in needed)
        own.add_argument("--glob", default="*.html,*.txt")
        own.add_argument("--config")
        own.add_argument("--job", type=int)
        own.add_argument("--idle", type=float, default=scheduler.IDLE)
        own.add_argument("--threshold", type=float, default=0.82)
        own.add_argument("--story", action="append", default=[])
        own.add_argument("--force", action="store_true")
        own.add_argument("--media", action="store_true")
    asked = parser.parse_args(arguments)
    said = COMMANDS[asked.command][0](spark or SparkSession.builder.getOrCreate(), asked)
    print(said)
    return said


if __name__ == "__main__":
    main()
