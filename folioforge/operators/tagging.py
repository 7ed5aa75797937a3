"""Proposing tags through a pluggable model, with failures kept per story."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import chunk_paragraphs, normalized_tags, rendered
from folioforge.model import Library
from folioforge.operators.facets import in_scope

MOST_TAGS = 20


class ExtractionError(Exception):
    """A single story's answer can't be used."""


class ServerError(Exception):
    """The model server can't be reached; the whole job fails."""


class TagModel(Protocol):
    """Answers a prompt with JSON ``{"tags": [...]}``.  Made anew in every task by a picklable factory."""

    def generate(self, prompt: str) -> str: ...


class Embedder(Protocol):
    def embed(self, text: str) -> list[float]: ...


def tags_of_answer(answer: str) -> list[str]:
    """The tags of a model's answer; at most MOST_TAGS, strings only."""
    try:
        tags = json.loads(answer)["tags"]
    except (ValueError, KeyError, TypeError) as e:
        raise ExtractionError(f"no usable answer: {e}") from e
    if not isinstance(tags, list) or len(tags) > MOST_TAGS:
        raise ExtractionError(f"{len(tags) if isinstance(tags, list) else 'no'} tags")
    return [t for t in tags if isinstance(t, str)]


def propose(stories: DataFrame, template: str, model: Callable[[], TagModel], most_chars: int) -> DataFrame:
    """(id, tags, error): per story the ordered union of its pieces' tags, or the error that cost it.

    Long bodies are packed into pieces in the JVM; the model sees one prompt per piece; a story's pieces stay in one row.
    """
    pieces = chunk_paragraphs(F.coalesce("body_text", F.lit("")), most_chars)
    note = lambda p, i, n: F.when(n > 1, F.concat(F.lit("[part "), i + 1, F.lit(" of "), n, F.lit("]\n"), p)).otherwise(p)
    rows = stories.select("id", "title", "author", pieces.alias("_p")).withColumn("_n", F.size("_p"))
    prompts = F.transform("_p", lambda p, i: rendered(F.lit(template), F.col("title"), F.col("author"), note(p, i, F.col("_n"))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model()
        for f in frames:
            tags, errors = [], []
            for story in f["prompts"]:
                try:
                    tags.append([t for p in story for t in tags_of_answer(own.generate(p))])
                    errors.append(None)
                except ExtractionError as e:
                    tags.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"id": f["id"], "tags": tags, "error": errors})

    out = rows.select("id", prompts.alias("prompts")).mapInPandas(run, "id string, tags array<string>, error string")
    return out.select("id", normalized_tags(F.col("tags")).alias("tags"), "error")


def embedded(texts: DataFrame, embedder: Callable[[], Embedder]) -> DataFrame:
    """(tag_text, vector): every distinct text is embedded once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = embedder()
        for f in frames:
            yield pd.DataFrame({"tag_text": f["tag_text"], "vector": [own.embed(t) for t in f["tag_text"]]})

    return texts.select("tag_text").distinct().mapInPandas(run, "tag_text string, vector array<double>")


def extract_job(library: Library, job: int, scope: str | None, template: str, model: Callable[[], TagModel], most_chars: int, version: str, model_name: str, now: str) -> dict[str, DataFrame]:
    """New proposals and errors of a job over its scope; stories it already has proposals for are left out."""
    todo = library.stories.join(in_scope(library, scope, job).select("id"), "id", "left_semi")
    out = propose(todo, template, model, most_chars)
    new = out.where("error is null").select(F.col("id").alias("story_id"), F.explode("tags").alias("tag_text"), F.lit(version).alias("prompt_version"), F.lit(model_name).alias("model"), F.lit(now).alias("created_at"), F.lit("candidate").alias("status"), F.lit(job).cast("bigint").alias("job_id"))
    lost = out.where("error is not null").select(F.lit(job).cast("bigint").alias("job_id"), F.col("id").alias("story_ref"), "error", F.lit(now).alias("created_at"))
    return {"tag_candidates": new, "job_errors": lost}
