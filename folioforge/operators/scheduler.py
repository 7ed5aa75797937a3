"""A worker that shares a library's extract and cluster jobs out in blocks, so that a model's calls stay together.

Each round gives every active job one block, jobs of one model in a row.  A block is one Spark job over at most ``block``
items and one committed version; the job's row is read again before it is committed, so a job that was cancelled
meanwhile keeps nothing of its block.  Extract jobs go on from the proposals that are stored; a cluster job's folding state
lives in the worker and starts anew with it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from folioforge.model import Conflict, _place, commit, current_version, opened
from folioforge.operators import clustering, jobs, mutate, runs, tagging
from folioforge.operators.jobs import ACTIVE, BLOCK

POLL, IDLE = 2.0, 30.0


@dataclass
class Folding:
    """What a worker holds of a cluster job: the texts in order, the next one, the folded clusters."""

    texts: list[str]
    fold: clustering.Fold
    at: int = 0
    cluster: list[int] = field(default_factory=list)


def lock_path(root: str) -> str:
    return f"{root}/worker.lock"


def locked(root: str) -> bool:
    """Takes the library's worker lock; False if another worker holds it."""
    fs, path = _place(lock_path(root))
    try:
        fs.create(path, False).close()
    except Exception:  # noqa: BLE001
        return False
    return True


def unlock(root: str) -> None:
    fs, path = _place(lock_path(root))
    fs.delete(path, False)


def status(tables: runs.Tables, pid: int | None) -> DataFrame:
    """(id, type, status, model, eta, worker) of the active jobs: when each will end, and the worker's process."""
    rows = jobs.active(tables["jobs"]).select("id", "type", "status", "model")
    return rows.join(jobs.completion(tables["jobs"]).select("id", "eta"), "id").withColumn("worker", F.lit(pid).cast("bigint"))


@dataclass
class Worker:
    """``model`` and ``embedder`` give, by a job's model name, a factory as ``tagging`` takes it."""

    spark: SparkSession
    root: str
    model: Callable[[str | None], Callable[[], tagging.TagModel]]
    embedder: Callable[[str | None], Callable[[], tagging.Embedder]]
    now: Callable[[], str]
    pid: int = 0
    block: int = BLOCK
    threshold: float = clustering.THRESHOLD
    most_chars: int = runs.CHARS
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    states: dict[int, Folding] = field(default_factory=dict)

    def active(self) -> list[Row]:
        """Active jobs in turn; states of ended ones are given up."""
        rows = jobs.active(opened(self.spark, self.root)["jobs"]).collect()
        for gone in set(self.states) - {r.id for r in rows}:
            del self.states[gone]
        return rows

    def store(self, row: Row, make: Callable[[runs.Tables], runs.Tables], again: int = 3) -> bool:
        """Commits what ``make`` makes of the newest tables, unless the job has ended meanwhile."""
        while True:
            base, _ = current_version(self.root)
            tables = opened(self.spark, self.root)
            if runs.job_row(tables, row.id).status not in ACTIVE:
                return False
            made = make(tables)
            if runs.job_row(opened(self.spark, self.root), row.id).status not in ACTIVE:
                return False
            try:
                commit(self.root, made, base)
                return True
            except Conflict:
                again -= 1
                if not again:
                    raise

    def extract_block(self, tables: runs.Tables, row: Row) -> runs.Tables:
        began = self.clock()
        made = runs.extract(tables, row, self.model(row.model), self.now(), self.pid, self.most_chars, self.block)
        after = {r.id: r for r in made["jobs"].where(F.col("id") == row.id).collect()}[row.id]
        items = after.done + after.failed - (row.done or 0) - (row.failed or 0)
        left = runs.View(tables)
        total = (row.total or 0) or tagging.in_scope(left, row.scope, row.id).count()
        ended = items < self.block or after.done + after.failed >= total
        state = dict(status="done", finished_at=self.now()) if ended else dict(status="running", finished_at=None)
        timed = dict(last_block_seconds=float(self.clock() - began), last_block_items=items) if items else {}
        return made | {"jobs": mutate.update(made["jobs"], F.col("id") == row.id, started_at=row.started_at or self.now(), total=total, **state, **timed)}

    def cluster_block(self, tables: runs.Tables, row: Row) -> runs.Tables:
        began = self.clock()
        held = self.states.get(row.id)
        if held is None:
            histogram = tables["tag_candidates"].where("status = 'candidate'").groupBy("tag_text").agg(F.min("id").alias("first_id"))
            held = self.states[row.id] = Folding([r.tag_text for r in histogram.orderBy("first_id").collect()], clustering.Fold(self.threshold))
        part = held.texts[held.at : held.at + self.block]
        if part:
            vectors = {r.tag_text: r.vector for r in tagging.embedded(self.spark.createDataFrame([(t,) for t in part], "tag_text string"), self.embedder(row.model)).collect()}
            held.cluster += [held.fold.add(np.array(vectors[t])) for t in part]
            held.at += len(part)
        ended = held.at >= len(held.texts)
        state = dict(status="done", finished_at=self.now()) if ended else dict(status="running")
        timed = dict(last_block_seconds=float(self.clock() - began), last_block_items=len(part)) if part else {}
        table = mutate.update(tables["jobs"], F.col("id") == row.id, started_at=row.started_at or self.now(), pid=self.pid, total=len(held.texts), done=held.at, **state, **timed)
        if not (ended and held.texts):
            return {"jobs": table}
        members = self.spark.createDataFrame(list(zip(held.texts, held.cluster, strict=True)), "tag_text string, cluster bigint")
        uses = tables["tag_candidates"].where("status = 'candidate'").groupBy("tag_text").agg(F.count("*").alias("uses"))
        names = clustering.cluster_names(members, uses)
        return mutate.write_clusters(tables["tag_candidates"], tables["tags"], tables["story_tags"], names, self.now(), row.id) | {"jobs": table}

    def round(self) -> int:
        """One block for every active job; how many were worked on."""
        rows = self.active()
        for row in rows:
            work = self.extract_block if row.type == "extract" else self.cluster_block
            try:
                # the block sees the row as it is when it is made
                self.store(row, lambda tables, w=work, i=row.id: w(tables, runs.job_row(tables, i)))
            except Conflict:
                raise
            except Exception as e:  # noqa: BLE001
                reason = str(e).splitlines()[0] if str(e) else type(e).__name__
                self.states.pop(row.id, None)
                self.store(row, lambda tables, i=row.id, r=reason: {"jobs": jobs.failed(tables["jobs"], i, r, self.now())})
        return len(rows)

    def run(self, idle: float = IDLE, poll: float = POLL) -> None:
        """Rounds until nothing has been active for ``idle`` seconds."""
        last = self.clock()
        while self.clock() - last < idle:
            if self.round():
                last = self.clock()
            else:
                self.sleep(poll)
