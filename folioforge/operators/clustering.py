"""Folding proposed tag texts into clusters by the similarity of their vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.82
#: The exact fold is sequential; a block of more vectors than this is refused rather than run for days.
LARGEST_BLOCK = 200_000


class Fold:
    """Greedy clusters: a vector joins the cluster of most similar centroid, the earliest of equals, or opens one."""

    def __init__(self, threshold: float):
        self.threshold, self.sums, self.count = threshold, np.zeros((0, 0)), np.zeros(0)

    def add(self, vector: np.ndarray) -> int:
        v = np.asarray(vector, float)
        k = len(self.count)
        if k:
            if v.shape[0] != self.sums.shape[1]:
                raise ValueError("vectors of different length")
            centroid = self.sums[:k] / self.count[:, None]
            norm = np.sqrt((centroid * centroid).sum(1)) * np.sqrt((v * v).sum())
            similarity = np.divide(centroid @ v, norm, out=np.zeros(k), where=norm > 0)
            best = int(similarity.argmax())
            if similarity[best] >= self.threshold:
                self.sums[best] += v
                self.count[best] += 1
                return best
        if k == len(self.sums):  # room for twice as many
            self.sums = np.vstack((self.sums.reshape(k, len(v)), np.zeros((max(16, k), len(v)))))
        self.sums[k] = v
        self.count = np.append(self.count, 1.0)
        return k


def greedy(vectors: DataFrame, key: str, vector: str, threshold: float = THRESHOLD, block: str | None = None) -> DataFrame:
    """(key, cluster): the fold in order of ``key``, the whole table in one sequence, or each ``block`` in its own.

    Without ``block`` the result depends on the order of all rows, so one task must see them; texts are distinct by
    then.  ``block`` is the way for more: any column whose values never share a cluster.
    """
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"), (F.col(block).cast("string") if block else F.lit("")).alias("b"))
    kind = vectors.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > LARGEST_BLOCK:
            raise ValueError(f"{len(frame)} vectors in one block; give a finer block column")
        fold = Fold(threshold)
        frame = frame.sort_values("k")
        label = [fold.add(v) for v in frame["v"]]
        return pd.DataFrame({"k": frame["k"], "b": frame["b"], "cluster": label})

    out = rows.groupBy("b").applyInPandas(run, f"k {kind}, b string, cluster bigint")
    return out.select(F.col("k").alias(key), *([F.col("b").alias(block)] if block else []), "cluster")


def cluster_names(clusters: DataFrame, histogram: DataFrame) -> DataFrame:
    """(tag_text, name): each member with its cluster's most used, then shortest, then first text."""
    rows = clusters.join(histogram.select("tag_text", "uses"), "tag_text")
    best = rows.groupBy("cluster").agg(F.min(F.struct((-F.col("uses")).alias("u"), F.length("tag_text").alias("n"), F.col("tag_text").alias("t"))).alias("m"))
    return rows.join(best, "cluster").select("tag_text", F.col("m.t").alias("name"))


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, position, value): the mean of each group's vectors, one row per position."""
    parts = vectors.select(group, F.posexplode(vector).alias("position", "x"))
    return parts.groupBy(group, "position").agg(F.avg(F.col("x").cast("double")).alias("value"))


#: Vectors in one packed block.
BLOCK_VECTORS = 2048


def packed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(block, keys, rows): vectors in blocks of at most about BLOCK_VECTORS, as the bytes of a matrix of unit vectors."""
    parts = max(1, -(-vectors.count() // BLOCK_VECTORS))
    rows = vectors.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int").alias("block"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.filter(pc.is_valid(table["v"]))
        if not table.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "rows": pa.array([], pa.binary())})
        m = np.array(table["v"].to_pylist(), float)
        n = np.sqrt((m * m).sum(1, keepdims=True))
        unit = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "keys": [table["k"].to_numpy().astype("<i8").tobytes()], "rows": [unit.tobytes()]})

    return rows.groupBy("block").applyInArrow(pack, "block int, keys binary, rows binary")


def similar_pairs(vectors: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """(a, b, similarity) of all pairs at or above ``least``.

    Vectors go out in packed blocks of a fixed size; every pair of blocks is one row of an equi-join on the pair's number and
    one matrix product, so no task holds more than two blocks whatever the table's size.
    """
    blocks = cached(packed(vectors, key, vector))
    n = blocks.count()
    mine = F.explode(F.transform(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)), lambda y: F.struct(F.least("block", y).alias("x"), F.greatest("block", y).alias("y")))).alias("pair")
    out = blocks.select("block", "keys", "rows", mine).select("block", "keys", "rows", "pair.x", "pair.y")
    left = out.where("block = x").select("x", "y", F.col("keys").alias("ka"), F.col("rows").alias("ma"))
    right = out.where("block = y").select("x", "y", F.col("keys").alias("kb"), F.col("rows").alias("mb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, ka, ma, kb, mb in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ka, kb = np.frombuffer(ka, "<i8"), np.frombuffer(kb, "<i8")
                s = np.frombuffer(ma).reshape(len(ka), -1) @ np.frombuffer(mb).reshape(len(kb), -1).T
                i, j = np.nonzero(s >= least)
                keep = ka[i] < kb[j] if x == y else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ka[i], kb[j])), pa.array(np.maximum(ka[i], kb[j])), pa.array(s[i, j])], names=["a", "b", "similarity"])

    pairs = left.join(right, ["x", "y"]).select("x", "y", "ka", "ma", "kb", "mb")
    return pairs.mapInArrow(run, "a bigint, b bigint, similarity double")


def cached(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def nearest_centroid(vectors: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """(key, nearest, similarity): each vector with the group of most similar mean (the smallest of equals).

    Means come in packed blocks too; each batch of vectors meets a block in one matrix product, and the best of the blocks
    is kept by a grouping on the key.
    """
    kind, name = vectors.schema[key].dataType.simpleString(), vectors.schema[group].dataType.simpleString()
    means = centroids(vectors, group, vector).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]).alias("mean"))
    means = means.select(F.col(group).alias("g"), "mean")
    parts = max(1, -(-means.count() // BLOCK_VECTORS))
    means = means.withColumn("block", F.pmod(F.xxhash64("g"), F.lit(parts)).cast("int"))
    spread = max(1, -(-vectors.count() // (16 * BLOCK_VECTORS)))
    left = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(F.col(key)), F.lit(spread)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block"))
    right = means.select("g", "mean", "block", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"))

    def meet(rows: pa.Table, groups: pa.Table) -> pa.Table:
        rows, groups = rows.filter(pc.is_valid(rows["v"])), groups.sort_by("g")
        if not (rows.num_rows and groups.num_rows):
            return pa.table({"k": rows["k"].slice(0, 0), "g": groups["g"].slice(0, 0), "s": pa.array([], pa.float64())})
        a, b = np.array(rows["v"].to_pylist(), float), np.array(groups["mean"].to_pylist(), float)
        norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
        s = np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm > 0)
        best = np.round(s, 9).argmax(1)  # the first of equals has the smallest group
        return pa.table({"k": rows["k"], "g": groups["g"].take(pa.array(best)), "s": s[np.arange(len(s)), best]})

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, f"k {kind}, g {name}, s double")
    best = found.groupBy("k").agg(F.min(F.struct((-F.round("s", 9)).alias("r"), "g", "s")).alias("m"))
    return best.select(F.col("k").alias(key), F.col("m.g").alias("nearest"), F.col("m.s").alias("similarity"))
