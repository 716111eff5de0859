"""Problem 1: what changed between consecutive full snapshots.

Each snapshot becomes, per hash bucket of its records, an invertible Bloom lookup table whose
cells are sums and XORs, so that tables are built by map-side combining and subtracted by one
more aggregation. Peeling the difference yields the differing (key hash, value hash) pairs only;
records that are equal in both snapshots cancel and are never compared or moved again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from codelode.functions.fingerprints import fingerprint, fingerprint128, xxh64_longs
from codelode.plans.scratch import cut
from codelode.plans.sizing import parts_for, small_side

HASHES = 3
RECORDS_PER_BUCKET = 1024
FIRST_CELLS = 48  # of each of the three parts of a bucket's table
MOST_ROUNDS = 16
_DIGEST = -1  # the row of a bucket that holds its digest instead of a cell


def ordered_labels(labels: DataFrame, label: str = "label", taken_at: str = "taken_at") -> DataFrame:
    """(label, pos): registered labels by their last taken_at, from 1; labels that were never taken (null) don't count.

    The one window without a partition runs over one row per label, i.e. per delivered snapshot.
    """
    last = (
        labels.select(F.col(label).alias("label"), F.col(taken_at).alias("taken_at"))
        .where(F.col("label").isNotNull() & F.col("taken_at").isNotNull())
        .groupBy("label")
        .agg(F.max("taken_at").alias("taken_at"))
    )
    return last.select("label", F.row_number().over(W.orderBy("taken_at", "label")).alias("pos"))


def _cells(pairs: DataFrame, cells: int, turn: int, last_pos: int, only: DataFrame | None = None) -> DataFrame:
    """Per (cmp, bucket) the non-zero cells of the subtracted tables, and their digest; only: the wanted (cmp, bucket)."""
    spots = [F.lit(_DIGEST)] + [
        (F.pmod(F.xxhash64(F.col("chk"), F.lit(turn * HASHES + j).cast("long")), F.lit(cells)) + j * cells).cast("int")
        for j in range(HASHES)
    ]
    # one exchange by bucket; the three aggregations below have the bucket among their keys and need no other
    tables = (
        pairs.repartition("bucket")
        .withColumn("cell", F.explode(F.array(*spots)))
        .withColumn("mix", F.when(F.col("cell") == _DIGEST, F.xxhash64("chk", F.lit(-7).cast("long"))).otherwise(F.col("chk")))
        .groupBy("pos", "bucket", "cell")
        .agg(F.count("*").alias("n"), *(F.bit_xor(c).alias(c) for c in ("k1", "k2", "v", "mix")))
    )
    # a snapshot is the later side of its own comparison and the earlier side of the next one
    sides = F.array(F.struct(F.col("pos").alias("cmp"), F.lit(1).alias("s")), F.struct((F.col("pos") + 1).alias("cmp"), F.lit(-1).alias("s")))
    sided = tables.withColumn("side", F.explode(sides)).select(F.col("side.cmp").alias("cmp"), F.col("side.s").alias("s"), "bucket", "cell", "n", "k1", "k2", "v", "mix").where(F.col("cmp").between(2, last_pos))
    if only is not None:
        sided = sided.join(only, ["cmp", "bucket"], "left_semi")
    return (
        sided.groupBy("cmp", "bucket", "cell")
        .agg(F.sum(F.col("n") * F.col("s")).alias("n"), *(F.bit_xor(c).alias(c) for c in ("k1", "k2", "v", "mix")))
        .where("n <> 0 or k1 <> 0 or k2 <> 0 or v <> 0 or mix <> 0")
        .groupBy("cmp", "bucket")
        .agg(F.collect_list(F.struct("cell", "n", "k1", "k2", "v", "mix")).alias("cells"))
        .select("cmp", "bucket", *(F.col(f"cells.{c}").alias(c) for c in ("cell", "n", "k1", "k2", "v", "mix")))
    )


def peel(group: np.ndarray, cell: np.ndarray, n: np.ndarray, k1: np.ndarray, k2: np.ndarray, v: np.ndarray, mix: np.ndarray, groups: int, cells: int, turn: int):
    """Decodes the tables of many buckets at once: (ok per group, items as group, k1, k2, v, sign)."""
    width = cells * HASHES
    flat = {name: np.zeros(groups * width, np.int64) for name in ("n", "k1", "k2", "v", "mix")}
    inner = cell != _DIGEST
    at = group[inner] * width + cell[inner]
    for name, values in (("n", n), ("k1", k1), ("k2", k2), ("v", v), ("mix", mix)):
        flat[name][at] = values[inner]
    digest_n, digest = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    digest_n[group[~inner]], digest[group[~inner]] = n[~inner], mix[~inner]
    found: list[tuple[np.ndarray, ...]] = []
    live = at
    while len(live):
        pure = live[np.abs(flat["n"][live]) == 1]
        if len(pure):
            pure = pure[xxh64_longs(flat["k1"][pure], flat["k2"][pure], flat["v"][pure]) == flat["mix"][pure]]
        if not len(pure):
            break
        own = pure // width
        with np.errstate(over="ignore"):  # an item shows in up to three cells; it is taken once
            _, first = np.unique(flat["mix"][pure] ^ (own * np.int64(0x9E3779B97F4A7C1)), return_index=True)
        pure, own = pure[first], own[first]
        item = [flat[x][pure].copy() for x in ("k1", "k2", "v", "mix", "n")]
        found.append((own, item[0], item[1], item[2], item[4]))
        touched = []
        for j in range(HASHES):
            spot = np.mod(xxh64_longs(item[3], np.full(len(own), turn * HASHES + j, np.int64)), cells) + j * cells + own * width
            np.subtract.at(flat["n"], spot, item[4])
            for name, values in zip(("k1", "k2", "v", "mix"), item):
                np.bitwise_xor.at(flat[name], spot, values)
            touched.append(spot)
        live = np.unique(np.concatenate(touched))
    parts = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [[]] * 5)]
    left = np.zeros(groups, bool)
    for values in flat.values():
        left |= (values.reshape(groups, width) != 0).any(axis=1)
    for_n, for_mix = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    if len(parts[0]):
        chk = xxh64_longs(parts[1], parts[2], parts[3])
        np.add.at(for_n, parts[0], parts[4])
        np.bitwise_xor.at(for_mix, parts[0], xxh64_longs(chk, np.full(len(chk), -7, np.int64)))
    return ~left & (for_n == digest_n) & (for_mix == digest), parts


def _peeler(cells: int, turn: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                sizes = part["cell"].map(len).to_numpy()
                group = np.repeat(np.arange(len(part)), sizes)
                columns = [np.concatenate(part[c].to_list()).astype(np.int64) for c in ("cell", "n", "k1", "k2", "v", "mix")]
                ok, (g, k1, k2, v, sign) = peel(group, *columns, len(part), cells, turn)
                keep = ok[g] if len(g) else np.zeros(0, bool)
                cmp_, bucket = part["cmp"].to_numpy(), part["bucket"].to_numpy()
                yield pd.DataFrame({"cmp": cmp_[g[keep]], "bucket": bucket[g[keep]], "k1": k1[keep], "k2": k2[keep], "sign": sign[keep].astype(np.int32)})
                bad = np.flatnonzero(~ok)
                yield pd.DataFrame({"cmp": cmp_[bad], "bucket": bucket[bad], "k1": 0, "k2": 0, "sign": np.zeros(len(bad), np.int32)})

    return run


def snapshot_changes(
    snapshots: DataFrame,
    labels: DataFrame,
    key: Sequence[str] = ("file", "name", "kind"),
    value: Sequence[str] = ("line", "symbol_id"),
    label: str = "label",
    taken_at: str = "taken_at",
    records_per_bucket: int = RECORDS_PER_BUCKET,
    first_cells: int = FIRST_CELLS,
) -> DataFrame:
    """(label, *key, change_kind) of each registered label against the one taken before it.

    A record is one key, its value the set of its distinct value tuples. Nulls in key and value
    columns are values like any other; repeated rows count once; rows under unregistered or null
    labels don't count; a label without rows is an empty snapshot; equal taken_at are ordered by
    label; with fewer than two labels, or on empty tables, the result is empty. Other columns are
    ignored, whatever their names.
    """
    order = cut(ordered_labels(labels, label, taken_at))
    n_labels = order.count()
    order = small_side(order, n_labels)
    k1, k2 = fingerprint128(*(F.col(c) for c in key))
    hashed = snapshots.select(F.col(label).alias("label"), k1.alias("k1"), k2.alias("k2"), fingerprint(*(F.col(c) for c in value), salt=3).alias("e")).join(order, "label").select("pos", "k1", "k2", "e")
    # two aggregations, each combined before its shuffle, so that a record that repeats without end stays harmless
    pairs = hashed.groupBy("pos", "k1", "k2", "e").agg(F.lit(1).alias("one")).groupBy("pos", "k1", "k2").agg(F.bit_xor("e").alias("v"))
    pairs = cut(pairs.withColumn("chk", F.xxhash64("k1", "k2", "v")))
    buckets = parts_for(pairs.count(), records_per_bucket * max(1, n_labels), most=1 << 30)
    pairs = pairs.withColumn("bucket", F.pmod(F.shiftright("k1", 7), F.lit(buckets)).cast("long"))

    schema = "cmp int, bucket long, k1 long, k2 long, sign int"
    done: list[DataFrame] = []
    todo, only, cells = pairs, None, first_cells
    for turn in range(MOST_ROUNDS):
        peeled = cut(_cells(todo, cells, turn, n_labels, only).mapInPandas(_peeler(cells, turn), schema))
        done.append(peeled.where("sign <> 0"))
        failed = peeled.where("sign = 0").select("cmp", "bucket")
        left = failed.count()
        if not left:
            break
        # only the buckets that failed are built again, with four times the cells
        cells *= 4
        only = small_side(failed, left)
        again = failed.select(F.explode(F.array(F.col("cmp"), F.col("cmp") - 1)).alias("pos"), "bucket").distinct()
        todo = pairs.join(small_side(again, 2 * left), ["pos", "bucket"], "left_semi")
    else:
        raise RuntimeError("tables could not be decoded")
    diff = done[0]
    for more in done[1:]:
        diff = diff.unionByName(more)
    kinds = (
        diff.groupBy("cmp", "k1", "k2")
        .agg(F.max("sign").alias("hi"), F.min("sign").alias("lo"))
        .select("cmp", "k1", "k2", F.when(F.col("lo") > 0, "added").when(F.col("hi") < 0, "removed").otherwise("changed").alias("change_kind"))
        .withColumn("pos", F.when(F.col("change_kind") == "removed", F.col("cmp") - 1).otherwise(F.col("cmp")))
    )
    kinds = cut(kinds)
    named = snapshots.select(F.col(label).alias("label"), *(F.col(c).alias(f"key{i}") for i, c in enumerate(key)))
    h1, h2 = fingerprint128(*(F.col(f"key{i}") for i in range(len(key))))
    names = [f"key{i}" for i in range(len(key))]
    named = named.join(order, "label").select("pos", h1.alias("k1"), h2.alias("k2"), *names)
    out = named.join(small_side(kinds), ["pos", "k1", "k2"]).groupBy("cmp", "k1", "k2", "change_kind", *names).agg(F.lit(1).alias("one"))
    return out.join(order.withColumnRenamed("pos", "cmp"), "cmp").select("label", *(F.col(f"key{i}").alias(c) for i, c in enumerate(key)), "change_kind")
