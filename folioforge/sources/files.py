"""Reading archives of text and HTML files, prompt templates and drop folders of signature files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.model import REQUIRED, SIGNATURE


def archive(spark: SparkSession, root: str, patterns: str = "*.html,*.txt") -> DataFrame:
    """(relpath, content): files below ``root`` that match any comma-separated pattern, each once."""
    globs = ",".join(p.strip() for p in patterns.split(",") if p.strip())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + globs + "}").load(root)
    base = os.path.abspath(root).rstrip("/") + "/"
    relpath = F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), base, -1)
    return files.select(relpath.alias("relpath"), "content").dropDuplicates(["relpath"])


def plain_text(content: Column) -> Column:
    """UTF-8 text with what can't be decoded replaced."""
    return F.make_valid_utf8(content.cast("string"))


def file_text(relpath: Column, content: Column) -> Column:
    """Text by the file's suffix; PDF files need the optional reader."""
    return F.when(F.lower(relpath).endswith(".pdf"), pdf_text(content)).otherwise(plain_text(content))


@F.pandas_udf(T.StringType())
def pdf_text(content):  # type: ignore[no-untyped-def]
    """Pages of a PDF with an empty line between; null where no PDF library is installed."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError:
        return content.map(lambda _: None).astype("object")
    return content.map(lambda c: c and "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(c)).pages))


def prompt_template(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def signatures(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): records of the folder's JSON files, and (file, reason) of those that aren't complete.

    A required key must be there, its value may be null; unknown keys are left out; nothing is converted.
    """
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return split_signatures(raw)


def split_signatures(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = F.json_object_keys("text")
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), keys)
    reason = F.when(keys.isNull(), "not a JSON object").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    judged = raw.withColumn("reason", reason)
    good = judged.where("reason is null").select("file", F.from_json("text", SIGNATURE).alias("s")).select("file", "s.*")
    good = good.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return good, judged.where("reason is not null").select("file", "reason")


def write_signatures(records: DataFrame, folder: str) -> None:
    """Records as JSON lines, nulls written."""
    records.select(*(f.name for f in SIGNATURE.fields)).write.option("ignoreNullFields", False).json(folder)


def with_hashes(fields: DataFrame, now: str) -> DataFrame:
    """Signatures of (relpath, group_key, part_index, title, author, body_text, tags)."""
    return fields.select(
        F.sha1("relpath").alias("id"), F.sha1("group_key").alias("group_id"), F.col("part_index").cast("int").alias("part_index"), "title", "author", "body_text",
        F.col("relpath").alias("source_relpath"), F.sha1("body_text").alias("content_hash"), F.lit(now).alias("ingested_at"), "tags", F.lit(None).cast("string").alias("media_path"),
    )
