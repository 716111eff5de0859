"""Problem 7: merging overlapping intervals per entity, and the gaps between them.

Time is cut into exact units. Per entity and shard of 2^16 units the covered units are a run
container: sorted runs (start, length - 1) of 16 bits each, at most 128 KB. Containers are united
in the map tasks first, so a hot entity or shard reaches the shuffle as compact runs. 256 shards
make a block; long intervals are runs of whole blocks. Set and clear runs inside a block are final, and only the first and last run of
each block are stitched along an entity, which bounds what one task sees by the time range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codelode.plans.scratch import cut

SHARD_BITS, BLOCK_BITS = 16, 8
BUFFER_ROWS = 200_000
HELD_CONTAINERS = 4096  # of one entity and block; beyond, they are united to one per shard
#: Finite times beyond so many units from 0 don't fit; they stop the query rather than be left out.
TOO_FAR = float(1 << 62)


def union_runs(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [start, end) united per group: overlapping, nested and touching ones become one."""
    if not len(start):
        return group, start, end
    # ranks instead of times keep the offsets of groups small
    times, rank = np.unique(np.concatenate((start, end)), return_inverse=True)
    s, e = rank[: len(start)], rank[len(start) :]
    order = np.lexsort((s, group))
    group, s, e = group[order], s[order], e[order]
    base = group.astype(np.int64) * (len(times) + 1)
    s, e = base + s, np.maximum.accumulate(base + e)
    at = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    last = np.concatenate((at[1:] - 1, [len(s) - 1]))
    return group[at], times[(s - base)[at]], times[e[last] - base[last]]


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (entity, shard, lo, hi) to one container per entity and shard."""
    keys = pdf.groupby(["entity", "shard"], sort=False).ngroup().to_numpy()
    firsts = np.unique(keys, return_index=True)[1]
    group, start, end = union_runs(keys, pdf["lo"].to_numpy(np.int64), pdf["hi"].to_numpy(np.int64))
    pairs = np.stack([start, end - start - 1], axis=1).astype("<u2")
    cuts = np.searchsorted(group, np.arange(len(firsts) + 1))
    return pd.DataFrame({"entity": pdf["entity"].to_numpy()[firsts], "shard": pdf["shard"].to_numpy()[firsts], "runs": [pairs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]})


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows >= BUFFER_ROWS:
            yield _pack(pd.concat(held, ignore_index=True))
            held, rows = [], 0
    if rows:
        yield _pack(pd.concat(held, ignore_index=True))


def _combine_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of whole blocks (entity, lo, hi), united within each task: no more than its time range has blocks."""

    def united(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pdf["entity"], use_na_sentinel=False)
        group, lo, hi = union_runs(codes, pdf["lo"].to_numpy(np.int64), pdf["hi"].to_numpy(np.int64))
        return pd.DataFrame({"entity": names[group], "lo": lo, "hi": hi})

    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows >= BUFFER_ROWS:
            held = [united(pd.concat(held, ignore_index=True))]
            rows = len(held[0])
            if rows >= BUFFER_ROWS // 2:
                yield held.pop()
                rows = 0
    if rows:
        yield united(pd.concat(held, ignore_index=True))


def _runs_of_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    sizes = pdf["runs"].map(len).to_numpy() // 4
    pairs = np.frombuffer(b"".join(pdf["runs"]), "<u2").reshape(-1, 2).astype(np.int64)
    start = (np.repeat(pdf["shard"].to_numpy(np.int64), sizes) << SHARD_BITS) + pairs[:, 0]
    end = start + pairs[:, 1] + 1
    entity, block = pdf["entity"].to_numpy(), pdf["block"].to_numpy(np.int64)
    change = np.concatenate(([True], (entity[1:] != entity[:-1]) | (block[1:] != block[:-1])))
    heads = np.flatnonzero(change)
    group, start, end = union_runs(np.repeat(np.cumsum(change) - 1, sizes), start, end)
    same = group[1:] == group[:-1]
    edge = np.concatenate(([True], ~same)) | np.concatenate((~same, [True]))
    names, blocks = entity[heads], block[heads]
    gap = np.flatnonzero(same)
    return pd.concat(
        [
            pd.DataFrame({"entity": names[group], "block": blocks[group], "what": np.where(edge, "edge", "covered"), "lo": start, "hi": end}),
            pd.DataFrame({"entity": names[group[gap]], "block": blocks[group[gap]], "what": "gap", "lo": end[gap], "hi": start[gap + 1]}),
        ]
    )


def _united(pdf: pd.DataFrame) -> pd.DataFrame:
    """Containers of one entity and block, one for each shard."""
    sizes = pdf["runs"].map(len).to_numpy() // 4
    pairs = np.frombuffer(b"".join(pdf["runs"]), "<u2").reshape(-1, 2).astype(np.int64)
    out = _pack(pd.DataFrame({"entity": np.repeat(pdf["entity"].to_numpy(), sizes), "shard": np.repeat(pdf["shard"].to_numpy(np.int64), sizes), "lo": pairs[:, 0], "hi": pairs[:, 0] + pairs[:, 1] + 1}))
    out.insert(1, "block", pdf["block"].iloc[0])
    return out


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by (entity, block); a block that goes on in the next batch waits for it, as one container a shard."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        entity, block = pdf["entity"].to_numpy(), pdf["block"].to_numpy()
        tail = np.flatnonzero((entity != entity[-1]) | (block != block[-1]))
        at = int(tail[-1]) + 1 if len(tail) else 0
        held = pdf.iloc[at:]
        if len(held) > HELD_CONTAINERS:
            held = _united(held)
        if at:
            yield _runs_of_blocks(pdf.iloc[:at].reset_index(drop=True))
    if held is not None and len(held):
        yield _runs_of_blocks(held.reset_index(drop=True))


def periods_and_gaps(rows: DataFrame, entity: str, start: str, end: str, unit: float = 0.25) -> DataFrame:
    """(entity, span, lo, hi) in units: `covered` for each continuous period, `gap` between two successive ones.

    Times are in seconds and whole multiples of `unit` (others are rounded to it). Rows with a null
    entity, start or end, with NaN or infinite times, or that don't end after they begin don't count;
    finite times of TOO_FAR units or more raise an error; repeated rows change nothing; entities
    without a counting row don't come out; other columns are ignored. Empty tables give an empty result.
    """
    # 1 / unit is exact for powers of two, so multiples stay exact
    units = lambda c: F.round(F.col(c).cast("double") * F.lit(1.0 / unit))
    usable = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    whole = lambda c: F.when(F.abs(c) < F.lit(TOO_FAR), c.cast("long")).otherwise(F.raise_error(F.lit("a time is too far from 0")).cast("long"))
    good = rows.select(F.col(entity).alias("entity"), units(start).alias("a"), units(end).alias("b")).where(F.col("entity").isNotNull() & usable(F.col("a")) & usable(F.col("b")))
    good = good.where("b > a").select("entity", whole(F.col("a")).alias("a"), whole(F.col("b")).alias("b"))
    shard_of = lambda c: F.shiftright(c, SHARD_BITS)
    good = good.withColumns({"sa": shard_of(F.col("a")), "sb": shard_of(F.col("b") - 1)})
    good = good.withColumns({"ba": F.shiftright("sa", BLOCK_BITS), "bb": F.shiftright("sb", BLOCK_BITS)})
    per = 1 << BLOCK_BITS
    # a long interval is single shards in its first and last block, and one run of the blocks between
    near = F.col("bb") - F.col("ba") <= 1
    shards: Column = F.when(near, F.sequence("sa", "sb")).otherwise(F.concat(F.sequence(F.col("sa"), (F.col("ba") + 1) * per - 1), F.sequence(F.col("bb") * per, F.col("sb"))))
    size = F.lit(1 << SHARD_BITS)
    pieces = (
        good.select("entity", "a", "b", F.explode(shards).alias("shard"))
        .select("entity", "shard", F.greatest(F.col("a") - F.col("shard") * size, F.lit(0)).alias("lo"), F.least(F.col("b") - F.col("shard") * size, size).alias("hi"))
        .mapInPandas(_combine, "entity string, shard long, runs binary")
        .select("entity", F.shiftright("shard", BLOCK_BITS).alias("block"), "shard", "runs")
    )
    # per entity one array of disjoint runs of whole blocks, at most half as many as its time range has blocks
    between = good.where(~near).select("entity", (F.col("ba") + 1).alias("lo"), F.col("bb").alias("hi")).mapInPandas(_combine_spans, "entity string, lo long, hi long")
    whole_blocks = cut(between.groupBy("entity").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans")))
    inside = F.exists("spans", lambda x: (x["lo"] <= F.col("block")) & (F.col("block") < x["hi"]))
    found = (
        pieces.join(whole_blocks, "entity", "left")
        .where(~F.coalesce(inside, F.lit(False)))
        .drop("spans")
        .repartition("entity", "block")
        .sortWithinPartitions("entity", "block")
        .mapInPandas(_blocks, "entity string, block long, what string, lo long, hi long")
    )
    width = SHARD_BITS + BLOCK_BITS
    spans = whole_blocks.select("entity", F.explode("spans").alias("x")).select("entity", F.col("x.lo").alias("block"), F.lit("edge").alias("what"), F.shiftleft("x.lo", width).alias("lo"), F.shiftleft("x.hi", width).alias("hi"))
    return _stitch(found.unionByName(spans))


def _stitch(found: DataFrame) -> DataFrame:
    """Joins the edges of blocks and the runs of whole blocks along each entity: a few rows a block, whatever the number of intervals."""
    found = cut(found)
    along = W.partitionBy("entity").orderBy("lo", "hi")
    edges = found.where("what = 'edge'").select(
        "entity", "lo", "hi", "block", F.max("hi").over(along.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.lag("block").over(along).alias("last_block")
    )
    edges = edges.withColumn("head", F.col("before").isNull() | (F.col("lo") > F.col("before")))
    islands = edges.withColumn("island", F.sum(F.col("head").cast("long")).over(along))
    covered = islands.groupBy("entity", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("entity", F.lit("covered").alias("span"), "lo", "hi")
    gaps = edges.where("head and before is not null and last_block <> block").select("entity", F.lit("gap").alias("span"), F.col("before").alias("lo"), F.col("lo").alias("hi"))
    inner = found.where("what <> 'edge'").select("entity", F.col("what").alias("span"), "lo", "hi")
    return inner.unionByName(covered).unionByName(gaps)
