"""Problem 4: references to records that do not exist.

Parent keys are cut into ranges of their 64-bit fingerprints and kept as sorted arrays, one per
range. References are first combined to distinct keys (a key with a third of all references is
probed once) and put into the same ranges; there are as many as the larger side needs, so a range
holds a bounded number of keys of both sides however few parents there are. A task walks through its
ranges with one array in hand and looks up batches of references by binary search. Only keys that
miss go back to the references; those that many references share go back by broadcast, as there can
only be a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions.fingerprints import fingerprint
from codelode.operators.snapshot_diff import ordered_labels
from codelode.plans.scratch import cut
from codelode.plans.sizing import parts_for, small_side

KEYS_PER_RANGE = 100_000
HOT_PARTS = 1024
HERE, BEFORE = 1, 2  # flags of a parent key: it exists now; it existed before

_PROBED = "k1 long, k2 long, flags int, born double, died double, n long"


def parent_keys(space: str, key: Column, flags: Column, born: Column | None = None, died: Column | None = None):
    """Columns of a parent row; space keeps equal strings of different kinds apart."""
    none = F.lit(None).cast("double")
    return [*_keys(F.lit(space), key), flags.cast("int").alias("flags"), (none if born is None else born).alias("born"), (none if died is None else died).alias("died")]


def _keys(space: Column, key: Column) -> list[Column]:
    return [fingerprint(space, key, salt=1).alias("k1"), fingerprint(space, key, salt=2).alias("k2")]


def _lookup(refs: pd.DataFrame, parents: tuple[np.ndarray, ...] | None) -> pd.DataFrame:
    """Those of refs that miss among the parents (k1, k2, flags, born, died), which are sorted by k1."""
    k1, k2 = refs["k1"].to_numpy(np.int64), refs["k2"].to_numpy(np.int64)
    flags, born, died = np.zeros(len(refs), np.int32), np.full(len(refs), np.nan), np.full(len(refs), np.nan)
    if parents is not None:
        p1, p2, pf, pb, pd_ = parents
        at = np.searchsorted(p1, k1, "left")
        while True:  # several parents may share k1; they follow each other
            inside = np.minimum(at, len(p1) - 1)
            more = (at < len(p1)) & (p1[inside] == k1) & (p2[inside] != k2)
            if not more.any():
                break
            at = at + more
        hit = (at < len(p1)) & (p1[inside] == k1)
        flags[hit], born[hit], died[hit] = pf[inside[hit]], pb[inside[hit]], pd_[inside[hit]]
    low, high = refs["low"].to_numpy(float), refs["high"].to_numpy(float)
    with np.errstate(invalid="ignore"):
        miss = ((flags & HERE) == 0) | (high > died) | (low < born)
    return pd.DataFrame({"k1": k1[miss], "k2": k2[miss], "flags": flags[miss], "born": born[miss], "died": died[miss], "n": refs["n"].to_numpy(np.int64)[miss]})


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (range, is a reference, k1): the parents of a range come before the references to it."""
    held, chunks, parents = None, [], None
    for pdf in batches:
        if not len(pdf):
            continue
        ranges, asks = pdf["range"].to_numpy(np.int64), pdf["ask"].to_numpy(bool)
        heads = np.flatnonzero(np.concatenate(([True], (ranges[1:] != ranges[:-1]) | (asks[1:] != asks[:-1]))))
        for a, b in zip(heads, [*heads[1:], len(pdf)]):
            part = pdf.iloc[a:b]
            if ranges[a] != held:
                held, chunks, parents = ranges[a], [], None
            if not asks[a]:
                chunks.append(tuple(part[c].to_numpy(t) for c, t in (("k1", np.int64), ("k2", np.int64), ("flags", np.int32), ("low", float), ("high", float))))
                continue
            if chunks:  # the sorted array of the range
                parents, chunks = tuple(map(np.concatenate, zip(*chunks))), []
            yield _lookup(part, parents)


def orphan_references(refs: DataFrame, parents: DataFrame, keys_per_range: int = KEYS_PER_RANGE) -> DataFrame:
    """The rows of refs (k1, k2, at, ...) whose key misses, with its state.

    parents: rows of parent_keys, several of one key being united. state is `missing`, or `deleted`
    if the key was there before or `at` is after its end, or `late` if `at` is before its begin. A
    null `at` is neither before nor after anything. Empty parents make every reference missing.
    """
    known = cut(parents.groupBy("k1", "k2").agg(F.bit_or("flags").alias("flags"), F.max("born").alias("born"), F.max("died").alias("died")))
    asked = cut(refs.groupBy("k1", "k2").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n")))
    sizes = asked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranges = parts_for(max(known.count(), sizes[0]), keys_per_range, most=1 << 30)
    # the order of unsigned fingerprints, cut into equal ranges
    in_range = F.shiftright(F.shiftrightunsigned("k1", 33) * F.lit(ranges).cast("long"), 31).alias("range")
    nan = F.lit(float("nan"))
    rows = known.select(in_range, F.lit(False).alias("ask"), "k1", "k2", "flags", F.coalesce("born", nan).alias("low"), F.coalesce("died", nan).alias("high"), F.lit(0).cast("long").alias("n"))
    rows = rows.unionByName(asked.select(in_range, F.lit(True).alias("ask"), "k1", "k2", F.lit(0).alias("flags"), "low", "high", "n"))
    misses = cut(rows.repartition("range").sortWithinPartitions("range", "ask", "k1").mapInPandas(_probe, _PROBED))
    # a hot miss has at least 1 / HOT_PARTS of all references, so there are at most HOT_PARTS of them
    most = max(sizes[1] // HOT_PARTS, 1000)
    hot = F.broadcast(misses.where(F.col("n") >= most).drop("n"))
    cold = small_side(misses.where(F.col("n") < most).drop("n"))
    back = refs.join(hot, ["k1", "k2"]).unionByName(refs.join(cold, ["k1", "k2"]))
    number = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    state = (
        F.when(F.col("flags") == 0, "missing")
        .when((F.col("flags").bitwiseAND(F.lit(HERE)) == 0) | (F.col("at") > number("died")), "deleted")
        .when(F.col("at") < number("born"), "late")
    )
    return back.withColumn("state", state).where("state is not null").drop("flags", "born", "died")


_VIRTUAL = r"^(module|builtin|binding):"


def _target_space(target: Column) -> Column:
    return (
        F.when(target.isNull() | target.rlike(_VIRTUAL) | (target == "@project"), None)
        .when(target.contains("#"), "symbol")
        .when(target.endswith("/"), "dir")
        .otherwise("path")
    )


def _target_key(target: Column) -> Column:
    return F.when(target.contains("#"), F.regexp_replace(target, r"[.#/!]\z", "")).otherwise(target)


def index_parents(symbol_snapshots: DataFrame, snapshot_labels: DataFrame, files: DataFrame, file_lifeline: DataFrame) -> DataFrame:
    """All keys that references of an index can mean. Null keys are no parents; repeated rows change nothing."""
    order = cut(ordered_labels(snapshot_labels))
    newest = order.agg(F.max("pos")).first()[0] or 0
    order = small_side(order)
    flag = F.when(F.col("pos") == newest, HERE).otherwise(BEFORE)
    symbols = symbol_snapshots.select("label", "file", "name").join(order, "label").select("file", "name", flag.alias("flag"))
    symbols = symbols.groupBy("file", "name").agg(F.bit_or("flag").alias("flag"))
    names = symbols.where("name is not null").select(*parent_keys("name", F.col("name"), F.col("flag")))
    named = symbols.where("file is not null and name is not null").select(*parent_keys("symbol", F.concat_ws("#", "file", "name"), F.col("flag")))
    paths = files.where("path is not null").select("path").distinct()
    # each prefix of a path that ends in a slash
    pieces = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.concat(F.array_join(F.slice(pieces, 1, i), "/"), F.lit("/")))
    dirs = paths.where(F.col("path").contains("/")).select(F.explode(prefixes).alias("dir")).distinct()
    dead = file_lifeline.where("current_path is not null and tombstoned_at is not null")
    lives = file_lifeline.where("id is not null").select(*parent_keys("life", F.col("id"), F.lit(HERE), F.col("created_at").cast("double"), F.col("tombstoned_at").cast("double")))
    out = names.unionByName(named).unionByName(paths.select(*parent_keys("path", F.col("path"), F.lit(HERE))))
    out = out.unionByName(dirs.select(*parent_keys("dir", F.col("dir"), F.lit(HERE))))
    return out.unionByName(dead.select(*parent_keys("path", F.col("current_path"), F.lit(BEFORE)))).unionByName(lives)


def index_references(refs: DataFrame, edges: DataFrame, annotations: DataFrame, file_event: DataFrame) -> DataFrame:
    """(src_table, ref_id, k1, k2, at): one row per row of the four tables that refers to something."""
    none = F.lit(None).cast("double")

    def rows(df: DataFrame, name: str, space: Column, key: Column, at: Column = none) -> DataFrame:
        good = df.where(F.col("id").isNotNull() & space.isNotNull() & key.isNotNull())
        return good.select(F.lit(name).alias("src_table"), F.col("id").cast("long").alias("ref_id"), *_keys(space, key), at.alias("at"))

    dst, target = F.col("dst"), F.col("target")
    return (
        rows(refs, "refs", F.lit("name"), F.col("name"))
        .unionByName(rows(edges, "edges", _target_space(dst), _target_key(dst)))
        .unionByName(rows(annotations, "annotations", _target_space(target), _target_key(target)))
        .unionByName(rows(file_event, "file_event", F.lit("life"), F.col("lifeline_id"), F.col("at").cast("double")))
    )


def orphans(refs: DataFrame, edges: DataFrame, annotations: DataFrame, file_event: DataFrame, symbol_snapshots: DataFrame, snapshot_labels: DataFrame, files: DataFrame, file_lifeline: DataFrame) -> DataFrame:
    """(src_table, ref_id, state), each id of a table once.

    Null references, virtual nodes and `@project` are no cases, nor are rows with a null id. If rows
    that repeat an id differ, its largest state holds. Empty tables work; no registered label makes
    every symbol missing.
    """
    found = orphan_references(index_references(refs, edges, annotations, file_event), index_parents(symbol_snapshots, snapshot_labels, files, file_lifeline))
    return found.groupBy("src_table", "ref_id").agg(F.max("state").alias("state"))


def orphans_by_month(found: DataFrame, refs: DataFrame, edges: DataFrame, annotations: DataFrame, file_event: DataFrame, files: DataFrame) -> DataFrame:
    """(src_table, month, state, orphans): month of created_at, at, or indexed_at of the file that refers; null if unknown."""
    seen = files.where("path is not null").groupBy("path").agg(F.max("indexed_at").alias("time"))

    def by_file(df: DataFrame, name: str, path: Column) -> DataFrame:
        own = df.where("id is not null").select(F.col("id").cast("long").alias("ref_id"), path.alias("path")).groupBy("ref_id").agg(F.max("path").alias("path"))
        return own.join(found.where(F.col("src_table") == name), "ref_id").join(seen, "path", "left").select("src_table", "state", "time")

    def by_time(df: DataFrame, name: str, time: str) -> DataFrame:
        own = df.where("id is not null").select(F.col("id").cast("long").alias("ref_id"), F.col(time).alias("time")).groupBy("ref_id").agg(F.max("time").alias("time"))
        return own.join(found.where(F.col("src_table") == name), "ref_id").select("src_table", "state", "time")

    rows = by_file(refs, "refs", F.col("file")).unionByName(by_file(edges, "edges", F.regexp_extract("src", "^[^#]*", 0)))
    rows = rows.unionByName(by_time(annotations, "annotations", "created_at")).unionByName(by_time(file_event, "file_event", "at"))
    month = F.date_format(F.timestamp_seconds("time"), "yyyy-MM")
    return rows.groupBy("src_table", month.alias("month"), "state").agg(F.count("*").alias("orphans"))
