"""Helpers shared by the operators: reading tables, cutting lineage, Arrow columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder that ``spark.checkpoint.dir`` names.

    A cluster must name one that all executors see; only under a local master is a temporary folder of our own
    set, as in tests.  Spark takes a checkpoint away when nothing refers to it any more, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("name a folder that all executors see in spark.checkpoint.dir")
        if named is None:
            named = tempfile.mkdtemp(prefix="folioforge-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint()


def per_batch(function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]):
    """A mapInArrow function from one that takes a single batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return run


def texts_of(batch: pa.RecordBatch, column: int) -> list:
    return batch.column(column).to_pylist()
