"""Whole jobs, the worker, snapshots and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from folioforge import cli
from folioforge.model import SCHEMAS, Conflict, backup, commit, current_version, opened, ready, versions
from folioforge.operators import jobs, mutate, runs, scheduler
from tests.conftest import values

T0 = "2026-01-01T00:00:00Z"


class Echo:
    """The words of the body after the colon; fails for stories that say so."""

    def generate(self, prompt):
        return "broken" if "fail" in prompt else json.dumps({"tags": prompt.split(":", 1)[1].split()})


class ByLetter:
    def embed(self, text):
        return [1.0, 0.0] if text.startswith("a") else [0.0, 1.0]


def refuse(text, relpath):
    if "bad" in relpath:
        raise ValueError("no story")
    return {"title": relpath, "author": "A", "body_text": text.strip(), "tags": ["site"]}


def story(key, body):
    return (key, key, 0, key.upper(), "A", body, f"{key}.html", "h", T0, "active", None, None)


@pytest.fixture
def library(spark, tmp_path):
    root = str(tmp_path / "lib")
    empty = opened(spark, root)
    stories = spark.createDataFrame([story("s1", "apple ant"), story("s2", "fail"), story("s3", "bee"), story("s4", "apple")], SCHEMAS["stories"])
    prompts = mutate.create_prompt(empty["prompts"], "v1", "tags:{body_text}", T0)
    table = empty["jobs"]
    for kind, prompt in (("extract", 1), ("cluster", None), ("extract", None), ("other", None)):
        table = jobs.create(table, kind, T0, prompt, "m").select(*SCHEMAS["jobs"].names)
    commit(root, {"stories": stories, "prompts": prompts, "jobs": table})
    return root


def ran(spark, root, job, **more):
    commit(root, runs.run_job(opened(spark, root), job, T0, 7, **more))
    return runs.job_row(opened(spark, root), job)


def test_extract_then_cluster(spark, library):
    row = ran(spark, library, 1, model=Echo)
    assert (row.status, row.total, row.done, row.failed, row.pid) == ("done", 4, 3, 1, 7)
    tables = opened(spark, library)
    assert values(tables["tag_candidates"], "id", "story_id", "tag_text", "prompt_version", "job_id") == [(1, "s1", "ant", "v1", 1), (2, "s1", "apple", "v1", 1), (3, "s3", "bee", "v1", 1), (4, "s4", "apple", "v1", 1)]
    ((ref, error),) = values(tables["job_errors"], "story_ref", "error")
    assert ref == "S2 (s2)" and error
    row = ran(spark, library, 2, embedder=ByLetter)
    assert (row.status, row.total, row.done) == ("done", 3, 3)
    tables = opened(spark, library)
    assert values(tables["tags"], "name") == [("apple",), ("bee",)]
    assert values(tables["story_tags"], "story_id", "source", "job_id") == [("s1", "model", 2), ("s3", "model", 2), ("s4", "model", 2)]
    assert values(tables["tag_candidates"], "status") == [("clustered",)] * 4


def test_what_ends_a_job_early_fails_it(spark, library):
    assert ran(spark, library, 3, model=Echo).error == "the job has no prompt"
    row = ran(spark, library, 4)
    assert row.status == "failed" and "other" in row.error
    with pytest.raises(ValueError, match="no such job"):
        runs.run_job(opened(spark, library), 99, T0)


def test_sync_counts_files_that_fail(spark, library, tmp_path):
    archive = tmp_path / "archive"
    archive.mkdir()
    for name, text in (("one.txt", "text one"), ("bad.txt", "x"), ("two.txt", "text two")):
        (archive / name).write_text(text)
    said = cli.main(["sync", "--library", library, "--archive", str(archive), "--adapter", "tests.test_runs:refuse", "--media"], spark)
    assert said == "job 5 done: 2 done, 1 failed"
    tables = opened(spark, library)
    assert values(tables["stories"].where("media_path is not null"), "title", "body_text", "media_path") == [("one.txt", "text one", "one.txt"), ("two.txt", "text two", "two.txt")]
    assert values(tables["job_errors"], "story_ref", "error") == [("bad.txt", "ValueError: no story")]
    assert values(tables["site_tags"]) == [("site", "site")] and tables["story_site_tags"].count() == 2
    assert "missing" not in cli.main(["parse", "--archive", str(archive), "--adapter", "tests.test_runs:refuse", "--out", str(tmp_path / "out")], spark)
    assert runs.signature_of(tables["stories"]).columns[-2:] == ["tags", "media_path"]


def test_command_line(spark, library, tmp_path):
    (tmp_path / "p.txt").write_text("tags:{body_text}")
    (tmp_path / "drop").mkdir()
    record = dict(zip(("id", "group_id", "part_index", "title", "author", "body_text", "source_relpath", "content_hash", "ingested_at"), story("n1", "apple bee")[:9], strict=True))
    (tmp_path / "drop" / "a.json").write_text(json.dumps(record))
    arguments = ["extract", "--library", library, "--drop", str(tmp_path / "drop"), "--prompt", str(tmp_path / "p.txt"), "--model", "tests.test_runs:Echo", "--version", "v9"]
    assert cli.main(arguments, spark) == "1 stories tagged, 0 failed, 0 files set aside"
    assert cli.main(arguments, spark).startswith("0 stories tagged")
    assert cli.main([*arguments, "--force"], spark).startswith("1 stories tagged")
    assert cli.main(["cluster", "--library", library, "--embedder", "tests.test_runs:ByLetter"], spark) == "2 texts in 2 tags"
    assert cli.main(["preview", "--library", library, "--prompt", str(tmp_path / "p.txt"), "--model", "tests.test_runs:Echo", "--story", "s1", "--story", "s3"], spark) == "s1: apple, ant\ns3: bee"
    assert cli.main(["backup", "--library", library, "--target", str(tmp_path / "copy")], spark).startswith("version 1")
    assert opened(spark, str(tmp_path / "copy"))["stories"].count() == 5
    with pytest.raises(SystemExit):
        cli.factory("no.such.module:x")


def test_versions_and_writers(spark, library):
    base, _ = current_version(library)
    commit(library, {"prompts": opened(spark, library)["prompts"]}, base)
    with pytest.raises(Conflict):
        commit(library, {"prompts": opened(spark, library)["prompts"]}, base)
    assert ready(library) and not ready(library + "-none") and versions(library) == [1, 2]
    # a version file that its writer left unfinished isn't read, and is no hindrance
    with open(f"{library}/versions/0000000003.json", "w") as f:
        f.write('{"sto')
    assert current_version(library)[0] == 2 and commit(library, {}) == 4
    assert backup(library, library + "-copy") == 1


def worker(spark, root, **more):
    return scheduler.Worker(spark, root, lambda _: Echo, lambda _: ByLetter, lambda: T0, 5, block=2, clock=iter(range(10_000)).__next__, sleep=lambda _: None, **more)


def test_worker_blocks_resume_and_end(spark, library):
    w = worker(spark, library)
    assert w.round() == 3
    rows = {r.id: r for r in opened(spark, library)["jobs"].collect()}
    assert (rows[1].status, rows[1].total, rows[1].done, rows[1].failed, rows[1].last_block_items) == ("running", 4, 1, 1, 2)
    assert rows[3].status == "failed" and rows[3].error == "the job has no prompt" and rows[4].status == "queued"
    worker(spark, library).run(idle=20)  # another worker goes on where the first one stopped
    rows = {r.id: r for r in opened(spark, library)["jobs"].collect()}
    assert rows[1].status == rows[2].status == "done" and (rows[1].done, rows[1].failed) == (3, 1)
    assert values(opened(spark, library)["tag_candidates"], "story_id", "tag_text") == [("s1", "ant"), ("s1", "apple"), ("s3", "bee"), ("s4", "apple")]


def test_a_cancelled_job_keeps_nothing_of_its_block(spark, library):
    w = worker(spark, library)
    made = w.extract_block

    def cancelled_meanwhile(tables, row):
        out = made(tables, row)
        commit(library, {"jobs": jobs.cancelled(opened(spark, library)["jobs"], 1, T0)})
        return out

    w.extract_block = cancelled_meanwhile
    (row,) = [r for r in w.active() if r.id == 1]
    assert not w.store(row, lambda t: w.extract_block(t, runs.job_row(t, 1)))
    assert opened(spark, library)["tag_candidates"].count() == 0
    w.states[1] = None
    assert {r.id for r in w.active()} == {2, 3} and w.states == {}


def test_status_and_lock(spark, library):
    table = jobs.block_timed(jobs.set_total(jobs.running(opened(spark, library)["jobs"], 1, T0, 9), 1, 100), 1, 10.0, 10)
    assert values(scheduler.status({"jobs": table}, 9).where("id = 1"), "status", "eta", "worker") == [("running", "~1m", 9)]
    assert scheduler.locked(library) and not scheduler.locked(library)
    scheduler.unlock(library)
    assert scheduler.locked(library)
    assert opened(spark, library)["jobs"].where(F.col("status") == "queued").count() == 4
