"""Incremental pick-up of signature files, and windowed counts over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.model import SCHEMAS, commit, opened, schema_of
from folioforge.operators.mutate import signature_site_links, upsert_stories
from folioforge.sources.files import split_signatures


def pick_up(spark: SparkSession, folder: str, root: str, checkpoint: str) -> None:
    """Upserts every new file of the folder into the library at ``root``; files already seen are left out.

    Runs once over what is there and ends; a repeated batch writes the same rows again.
    """
    files = spark.readStream.schema(schema_of("value string")).option("wholetext", True).option("pathGlobFilter", "*.json").format("text").load(folder)

    def store(batch: DataFrame, _: int) -> None:
        good, _bad = split_signatures(batch.select(F.lit("").alias("file"), F.col("value").alias("text")))
        tables = opened(batch.sparkSession, root)
        records = good.drop("file")
        stories = upsert_stories(tables["stories"], records).select(*SCHEMAS["stories"].names)
        commit(root, {"stories": stories, "story_site_tags": signature_site_links(tables["story_site_tags"], records)})

    files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; works on a stream and on a table alike."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    rows = source.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")
