"""Problem 2: how often two items occur together, and how much more often than chance.

Method: heavy-light decomposition.  An item that holds at least 1/HEAVY_PARTS of all links is heavy, so
at most HEAVY_PARTS items are, whatever the data.  Records come in blocks, one block per task step:

* heavy-heavy: each heavy item is a row of bits over a strip of records; a pair's count is the popcount
  of the AND of two rows;
* light-light: the pairs inside each record's short list of light items, counted in a hash table;
* heavy-light: every light link probes its record's list of heavy items.

Each block emits its partial counts once, already added up; one small shuffle by pair adds the blocks.

Plan: one shuffle turns the links into a table of records with their different items, repeats being dropped before it; it is
written once, and item counts, the number of records, record sizes and the pairs all come from it without moving a record
again.

Skew: a record's list is as long as it has different items, whatever its number of rows; a record with
more than BASKET items is cut into chunks of BASKET / 2 and its chunk pairs are spread over the cluster, so no
task pairs an unbounded record.  A hot item only makes a denser bit row.

Defined results: links with a null item or record are left out (n counts records with at least one item);
repeated links count once; an empty table gives no pairs; lift is n_ab * n / (n_a * n_b).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import cut

HEAVY_PARTS, BASKET, BLOCK_LINKS = 1024, 4096, 1 << 20
#: Records per strip of bit rows (64 per word), and pairs that go into the hash table at a time.
STRIP, PAIRS_AT_ONCE = 1 << 16, 1 << 22
_PARTIAL = "a bigint, b bigint, c bigint"


class Counts:
    """Counted pairs, added up by hash."""

    def __init__(self) -> None:
        self.parts: list[pa.Table] = []
        self.rows = 0

    def add(self, a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> None:
        if len(a):
            self.parts.append(pa.table({"a": a, "b": b, "c": np.ones(len(a), np.int64) if c is None else c}))
            self.rows += len(a)
            if self.rows > PAIRS_AT_ONCE:
                self.parts = [self.total()]
                self.rows = self.parts[0].num_rows // 2  # the table may double before it is added up again

    def total(self) -> pa.Table:
        rows = pa.concat_tables(self.parts) if self.parts else pa.table({k: np.zeros(0, np.int64) for k in "abc"})
        return rows.group_by(["a", "b"], use_threads=False).aggregate([("c", "sum")]).rename_columns(["a", "b", "c"])


def heavy_pairs(rows: np.ndarray, items: np.ndarray, n: int, kinds: int) -> np.ndarray:
    """How many of n records hold both of two heavy items (numbered from 0), from popcounts of bit rows."""
    together = np.zeros((kinds, kinds), np.int64)
    for first in range(0, n, STRIP):
        a, b = np.searchsorted(rows, (first, first + STRIP))
        row, item = rows[a:b] - first, items[a:b]
        words = (min(STRIP, n - first) + 63) // 64
        at = item * words + (row >> 6)
        o = np.argsort(at, kind="stable")
        edge = np.flatnonzero(np.diff(at[o], prepend=-1))
        bits = np.zeros(kinds * words, np.uint64)
        if len(edge):
            bits[at[o][edge]] = np.bitwise_or.reduceat(np.uint64(1) << (row[o] & 63).astype(np.uint64), edge)
        bits = bits.reshape(kinds, words)
        for i in range(kinds - 1):
            together[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(1, dtype=np.int64)
    return together


def count_block(size: np.ndarray, items: np.ndarray, heavy: np.ndarray) -> pa.Table:
    """(a, b, c), a < b, of one block of records: how many items each has, and the items one record after another;
    ``heavy`` sorted."""
    n = len(size)
    row = np.repeat(np.arange(n), size)
    at = np.searchsorted(heavy, items)
    is_heavy = (at < len(heavy)) & (heavy[np.minimum(at, len(heavy) - 1)] == items) if len(heavy) else np.zeros(len(items), bool)
    counts = Counts()
    hrow, hitem = row[is_heavy], at[is_heavy]
    present, local = np.unique(hitem, return_inverse=True)
    together = heavy_pairs(hrow, local, n, len(present))
    i, j = np.nonzero(together)
    counts.add(heavy[present[i]] if len(i) else i, heavy[present[j]] if len(j) else j, together[i, j])
    lrow, litem = row[~is_heavy], items[~is_heavy]
    if len(litem):
        order = np.lexsort((litem, lrow))
        lrow, litem = lrow[order], litem[order]
        for d in range(1, int(np.bincount(lrow).max())):
            same = lrow[d:] == lrow[:-d]
            counts.add(litem[:-d][same], litem[d:][same])
        held = np.bincount(hrow, minlength=n)
        start = np.r_[0, np.cumsum(held)]
        hits = held[lrow]
        light = np.repeat(litem, hits)
        place = np.arange(len(light)) - np.repeat(np.r_[0, np.cumsum(hits)[:-1]], hits)
        probe = heavy[hitem[np.repeat(start[lrow], hits) + place]] if len(light) else light
        counts.add(np.minimum(light, probe), np.maximum(light, probe))
    return counts.total()


def pair_counts(links: DataFrame, record_col: str = "story_id", item_col: str = "tag_id") -> tuple[DataFrame, DataFrame, int]:
    """((a, b, n_ab), (item, n_item), n).  Only scalars and at most HEAVY_PARTS item ids come to the driver."""
    rows = links.select(F.col(record_col).alias("r"), F.col(item_col).cast("bigint").alias("i")).where("r is not null and i is not null")
    records = cut(rows.groupBy("r").agg(F.collect_set("i").alias("items")).select("items"))
    counts = records.select(F.explode("items").alias("i")).groupBy("i").agg(F.count("*").alias("n_i"))
    seen = records.agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("links"), F.max(F.size("items")).alias("most")).first()
    heavy = np.array(sorted(x.i for x in counts.where(F.col("n_i") * HEAVY_PARTS >= max(1, seen.links or 0)).select("i").collect()), np.int64)

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0
        for batch in batches:
            lists = batch.column(0)
            held.append((np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()))
            many += len(held[-1][1])
            if many >= BLOCK_LINKS:
                yield from count_block(*(np.concatenate(x) for x in zip(*held, strict=True)), heavy).to_batches()
                held, many = [], 0
        if held:
            yield from count_block(*(np.concatenate(x) for x in zip(*held, strict=True)), heavy).to_batches()

    partial = records.where(F.size("items") <= BASKET).mapInArrow(run, _PARTIAL)
    if (seen.most or 0) > BASKET:
        half = BASKET // 2
        last = F.floor((F.size("items") - 1) / half).cast("int")
        wide = records.where(F.size("items") > BASKET).select("items", F.explode(F.sequence(F.lit(0), last)).alias("x"), last.alias("last"))
        wide = wide.select("items", "x", F.explode(F.sequence("x", "last")).alias("y"))
        part = lambda k: F.slice("items", F.col(k) * half + 1, half)
        pairs = wide.select(part("x").alias("a"), part("y").alias("b"), (F.col("x") == F.col("y")).alias("same")).repartition(F.xxhash64("a", "b"))

        def chunks(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for a, b, same in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    a, b = np.array(a, np.int64), np.array(b, np.int64)
                    x, y = np.repeat(a, len(b)), np.tile(b, len(a))
                    keep = x < y if same else np.ones(len(x), bool)
                    x, y = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.ones(len(x), np.int64))], names=["a", "b", "c"])

        partial = partial.unionByName(pairs.mapInArrow(chunks, _PARTIAL))
    return partial.groupBy("a", "b").agg(F.sum("c").alias("n_ab")), counts, seen.n


def lifts(links: DataFrame, record_col: str = "story_id", item_col: str = "tag_id", min_together: int = 1) -> DataFrame:
    """(tag_id_a, tag_id_b, n_ab, n_a, n_b, n, lift) of every pair with at least ``min_together`` records."""
    pairs, counts, n = pair_counts(links, record_col, item_col)
    side = lambda s: counts.select(F.col("i").alias(s), F.col("n_i").alias(f"n_{s}"))
    return (
        pairs.where(F.col("n_ab") >= min_together)
        .join(side("a"), "a")
        .join(side("b"), "b")
        .select(F.col("a").alias("tag_id_a"), F.col("b").alias("tag_id_b"), "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"))
        .withColumn("lift", F.col("n_ab") * F.col("n").cast("double") / (F.col("n_a") * F.col("n_b").cast("double")))
    )


def related(links: DataFrame, min_together: int = 5, times_chance: int = 3) -> DataFrame:
    """(tag_id_a, tag_id_b) of pairs that come together at least ``times_chance`` times as often as by chance."""
    exact = "cast(n_ab as decimal(19,0)) * n >= cast(n_a as decimal(19,0)) * n_b * " + str(int(times_chance))
    return lifts(links, min_together=min_together).where(F.expr(exact)).select("tag_id_a", "tag_id_b")
