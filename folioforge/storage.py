"""Where intermediate results lie: a folder that every executor sees."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's folder below ``spark.checkpoint.dir``.

    A cluster must name one; only under a local master, as in tests, a temporary folder of our own serves and is removed
    at the end.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("name a folder that all executors see in spark.checkpoint.dir")
        if named is None:
            named = tempfile.mkdtemp(prefix="folioforge-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()
