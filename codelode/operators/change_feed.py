"""Problem 2: the current state of a table from a repeated, unordered change feed.

The feed tells transitions (before, after) of a key. The order comes from the transitions
themselves, as clocks may be wrong: each edit adds 1 to the state it leads to and takes 1 from
the state it leaves, so only the last state keeps 1 (a walk through all edits ends where more
edits arrive than leave). Sums, minima and maxima don't depend on the order of delivery; the
result is the largest struct (sequence, operation, payload) per key, with deletions kept as
tombstones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fold_changes(
    feed: DataFrame,
    base: DataFrame | None = None,
    key: str = "path",
    before: str = "prev_hash",
    after: str = "new_hash",
    ts: str = "ts",
    session: str = "session_id",
) -> DataFrame:
    """(key, op, state, edits): op is `upsert`, or `delete` with a null state, after the last edit of each key.

    base: rows (key, after) known before the feed; they hold where the feed has no edit of the key.
    An edit is one distinct (key, before, after, session), nulls being equal, however often and with
    whatever other columns it comes. If all edits of a key form a closed walk, it ends where it
    began: at the base row's state if there is one; else at null (no record) if the walk passes
    through null, as a key that no base row knows begins without a record; else at the state with the
    longest time from first being left to last being reached, then the later, then the larger state. Rows with a null key are left out; a null ts counts as unknown; edits that change
    nothing (before = after) leave the state as it is. Empty feeds give the base, if any.
    """
    k = F.col(key).alias("k")
    edits = (
        feed.where(F.col(key).isNotNull())
        .select(k, F.col(before).alias("b"), F.col(after).alias("a"), F.col(session).alias("s"), F.col(ts).alias("t"))
        .groupBy("k", "b", "a", "s")
        .agg(F.min("t").alias("t"))
    )
    null_time = F.lit(None).cast("double")
    steps = edits.select(
        "k",
        F.explode(
            F.array(
                F.struct(F.col("a").alias("state"), F.lit(1).alias("w"), F.col("t").cast("double").alias("came"), null_time.alias("left")),
                F.struct(F.col("b").alias("state"), F.lit(-1).alias("w"), null_time.alias("came"), F.col("t").cast("double").alias("left")),
            )
        ).alias("x"),
    ).select("k", "x.*")
    if base is not None:
        rows = base.where(F.col(key).isNotNull()).select(k, F.col(after).alias("state"), F.lit(0).alias("w"), null_time.alias("came"), null_time.alias("left"))
        steps = steps.unionByName(rows)
    states = steps.groupBy("k", "state").agg(
        F.sum("w").alias("net"), F.max("came").alias("came"), F.min("left").alias("left"), F.count(F.when(F.col("w") > 0, 1)).alias("edits"), F.max((F.col("w") == 0).cast("int")).alias("known")
    )
    # the sequence: arrivals less departures; where all are equal, the place at which the walk began
    home = F.col("known") * 2 + F.col("state").isNull().cast("int")
    best = F.max(F.struct("net", home.alias("home"), (F.col("came") - F.col("left")).alias("span"), "came", F.when(F.col("state").isNull(), "delete").otherwise("upsert").alias("op"), "state"))
    return states.groupBy("k").agg(best.alias("best"), F.sum("edits").alias("edits")).select(F.col("k").alias(key), F.col("best.op").alias("op"), F.col("best.state").alias("state"), "edits")


def current_rows(feed: DataFrame, base: DataFrame | None = None, key: str = "path", after: str = "new_hash", name: str = "hash", **columns: str) -> DataFrame:
    """(key, name) of the keys that exist after their last edit; see fold_changes."""
    return fold_changes(feed, base, key=key, after=after, **columns).where("op = 'upsert'").select(key, F.col("state").alias(name))
