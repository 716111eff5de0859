"""Problem 9: filling windows of one fixed capacity with texts, best fit first for the largest.

Texts are dealt to shards of a bounded number of tokens by the hash of their id; each shard is
packed by best-fit decreasing with a segment tree over the remaining capacities, so each text
finds the tightest open window in logarithmic time. Shards differ from one global packing by at
most the space left in their last windows, which is a fixed small part of a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

WINDOWS_PER_SHARD = 4096
ITEMS_PER_SHARD = 200_000


class Remaining:
    """Open windows by remaining capacity; the tree tells the least remaining capacity that suffices."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1).bit_length()
        self.used = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, window: int) -> None:
        self.open[remaining].append(window)
        at = self.size + remaining
        while at and not self.used[at]:
            self.used[at] = 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(window, remaining) of a tightest window with at least so much space."""
        used, at = self.used, self.size + least
        if not used[at]:
            while at > 1 and (at & 1 or not used[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if used[2 * at] else 2 * at + 1
        remaining = at - self.size
        window = self.open[remaining].pop()
        if not self.open[remaining]:
            used[at] = 0
            at >>= 1
            while at and not used[2 * at] and not used[2 * at + 1]:
                used[at] = 0
                at >>= 1
        return window, remaining


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset, windows) for items of at most the capacity; equal sizes keep their order."""
    window, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree, count = Remaining(capacity), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        got = tree.take(size)
        if got is None:
            got, count = (count, capacity), count + 1
        window[i], offset[i] = got[0], capacity - got[1]
        tree.put(got[1] - size, got[0])
    return window, offset, count


def _packer(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "part"], kind="stable")
        window, offset, _ = best_fit_decreasing(pdf["tokens"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"id": pdf["id"], "part": pdf["part"], "window": pdf["shard"].to_numpy(np.int64) * (1 << 32) + window, "offset": offset.astype(np.int32), "tokens": pdf["tokens"]})

    return run


def pack(items: DataFrame, capacity: int, item_id: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(item_id, part, window, offset, tokens): where each item begins in its window.

    An item is split only if it alone exceeds the capacity: into full windows and a rest, numbered by
    part. Items of size 0 lie in some window and take no space. Null and negative sizes count as 0;
    rows with a null id are left out; a repeated id is packed as often as it comes. No items give no rows.
    """
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("id"), n.alias("n"))
    total, count = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total // (capacity * WINDOWS_PER_SHARD)), -(-count // ITEMS_PER_SHARD))
    last = F.greatest(F.ceil(F.col("n") / F.lit(capacity)).cast("int") - 1, F.lit(0))
    parts = rows.select("id", "n", F.explode(F.sequence(F.lit(0), last)).alias("part")).select("id", "part", F.least(F.col("n") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("tokens"))
    # parts of one very long item, too, go to different shards
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("id", "part"), F.lit(shards)))
    placed = dealt.groupBy("shard").applyInPandas(_packer(capacity), "id long, part int, window long, offset int, tokens int")
    return placed.withColumnRenamed("id", item_id)


def windows(packed: DataFrame, capacity: int) -> DataFrame:
    """(fill, windows): how many windows are filled to which percent."""
    filled = packed.groupBy("window").agg(F.sum("tokens").alias("tokens"))
    return filled.groupBy(F.floor(F.col("tokens") * 100 / capacity).cast("int").alias("fill")).agg(F.count("*").alias("windows"))
