"""Schemas of a library's tables, and opening, checking and committing a library."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}


def schema_of(text: str) -> T.StructType:
    """A schema from ``name type, ...``, without a session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in text.split(","))])


#: The tables of a library with their columns and types.
SCHEMAS: dict[str, T.StructType] = {
    "stories": schema_of("id string, group_id string, part_index int, title string, author string, body_text string, source_relpath string, content_hash string, ingested_at string, status string, removed_at string, media_path string"),
    "tag_candidates": schema_of("id bigint, story_id string, tag_text string, prompt_version string, model string, created_at string, status string, job_id bigint"),
    "tags": schema_of("id bigint, name string, description string, created_at string"),
    "story_tags": schema_of("story_id string, tag_id bigint, confidence double, source string, job_id bigint"),
    "site_tags": schema_of("code string, label string"),
    "story_site_tags": schema_of("story_id string, code string"),
    "prompts": schema_of("id bigint, name string, text string, based_on_id bigint, created_at string"),
    "jobs": schema_of("id bigint, type string, status string, prompt_id bigint, model string, scope string, total bigint, done bigint, failed bigint, pid bigint, error string, created_at string, started_at string, finished_at string, reverted_at string, last_block_seconds double, last_block_items bigint"),
    "job_errors": schema_of("id bigint, job_id bigint, story_ref string, error string, created_at string"),
}
SIGNATURE = schema_of("id string, group_id string, part_index int, title string, author string, body_text string, source_relpath string, content_hash string, ingested_at string, tags array<string>, media_path string")
REQUIRED = ("id", "group_id", "part_index", "title", "author", "body_text", "source_relpath", "content_hash", "ingested_at")
#: Defaults of columns that older snapshots may lack.
ADDED = {"stories": {"status": "active", "removed_at": None, "media_path": None}, "tag_candidates": {"job_id": None}, "story_tags": {"job_id": None}, "jobs": {"reverted_at": None, "last_block_seconds": None, "last_block_items": None}}
KEYS = {"stories": ["id"], "tags": ["id"], "story_tags": ["story_id", "tag_id"], "site_tags": ["code"], "story_site_tags": ["story_id", "code"], "prompts": ["id"], "jobs": ["id"], "tag_candidates": ["id"], "job_errors": ["id"]}


def evolve(df: DataFrame, name: str) -> DataFrame:
    """The table with columns that older snapshots lack, in the schema's order and types."""
    for column, default in ADDED.get(name, {}).items():
        if column not in df.columns:
            df = df.withColumn(column, F.lit(default))
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields))


def latest(stories: DataFrame) -> DataFrame:
    """One row per story id: the one ingested last."""
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("ingested_at"))
    return stories.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


@dataclass(frozen=True)
class Library:
    """Named, lazily read tables; ``library.stories`` has one row per id, ``library.links`` one per (story, tag)."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, f"{name}.parquet"))

    @property
    def stories(self) -> DataFrame:
        return latest(self.table("stories"))

    @property
    def active(self) -> DataFrame:
        return self.stories.where(F.col("status") == "active")

    @property
    def links(self) -> DataFrame:
        """Links of stories and tags; of a repeated link the human one counts, then the earliest job's."""
        w = Window.partitionBy("story_id", "tag_id").orderBy("source", F.asc_nulls_first("job_id"))
        return self.table("story_tags").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)


# -- checks ----------------------------------------------------------------------------------------------


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The key values that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose reference isn't in ``parent``."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if not duplicated(df, keys).isEmpty():
        raise ValueError(f"values of {', '.join(keys)} aren't unique")
    return df


# -- snapshots -------------------------------------------------------------------------------------------


class Conflict(RuntimeError):
    """Another writer committed first."""


def _place(path: str):
    """(file system, path) of the session's Hadoop configuration: local, HDFS or an object store."""
    spark = SparkSession.getActiveSession()
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def versions(root: str) -> list[int]:
    fs, folder = _place(f"{root}/versions")
    return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json")) if fs.exists(folder) else []


def _version(root: str, number: int) -> dict[str, str] | None:
    try:
        return json.loads(SparkSession.getActiveSession().read.text(f"{root}/versions/{number:010d}.json", wholetext=True).first()[0])
    except (TypeError, ValueError):
        return None  # still being written, or its writer was lost


def current_version(root: str) -> tuple[int, dict[str, str]]:
    """(number, table name to path) of the newest whole version; (0, {}) if there is none."""
    for number in reversed(versions(root)):
        if (where := _version(root, number)) is not None:
            return number, where
    return 0, {}


def current(root: str) -> dict[str, str]:
    return current_version(root)[1]


def commit(root: str, tables: dict[str, DataFrame], base: int | None = None) -> int:
    """Writes tables beside the older ones and then a version that names them; a reader sees one version or another.

    Tables that aren't given are taken over by reference.  The version file is created only if it isn't there, and with
    ``base``, the version that the tables were made from, only if that is still the newest: so two writers can't lose an
    update, one of them gets ``Conflict``.
    """
    now, where = current_version(root)
    if base is not None and base != now:
        raise Conflict(f"version {now} was committed after {base}")
    where, name = dict(where), uuid.uuid4().hex[:12]
    for table, df in tables.items():
        where[table] = f"{root}/{name}/{table}.parquet"
        df.write.parquet(where[table])
    number = max(versions(root), default=0) + 1
    if base is not None and current_version(root)[0] != base:
        raise Conflict(f"another version was committed after {base}")
    fs, path = _place(f"{root}/versions/{number:010d}.json")
    try:
        out = fs.create(path, False)
    except Py4JJavaError as e:
        raise Conflict(f"version {number} exists") from e
    out.write(bytearray(json.dumps(where).encode()))
    out.close()
    return number


def opened(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the newest if none is named, evolved; tables that were never written are empty."""
    paths = current(root) if number is None else _version(root, number) or {}
    return {name: evolve(spark.read.parquet(paths[name]), name) if name in paths else spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def backup(root: str, target: str) -> int:
    """A copy of the newest version as a library of its own; writers may go on meanwhile, as versions don't change."""
    spark = SparkSession.getActiveSession()
    return commit(target, {name: spark.read.parquet(path) for name, path in current(root).items()})


def ready(root: str) -> bool:
    """Is there a version whose tables can be read with all columns that have no default?"""
    spark = SparkSession.getActiveSession()
    paths = current(root)
    lacking = [name for name, path in paths.items() if {f.name for f in SCHEMAS[name].fields} - set(spark.read.parquet(path).columns) - set(ADDED.get(name, ()))]
    return bool(paths) and not lacking
